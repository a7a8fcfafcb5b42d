"""Fixed word lists and lookup tables.

The values in this file are fixed: results only agree with existing statements
and rule sets when these exact tokens, aliases and phrases are used.
"""

# Cell texts that mean "no value".
NULL_TOKENS = [
    "", "-", "--", "NIL", "nil", "Nil", "N/A", "n/a", "NA", "na", "NaN", "nan",
    "NULL", "null", ".", "0.00", "0", "00", "0.0",
]

# Cell texts that mean "no amount" (compared in lower case).
EMPTY_AMOUNTS = ["", "-", "--", "nil", "n/a", "na", "nan", "null", "—", "–"]

# Source column name -> target column.
COLUMN_ALIASES = {
    "txn date": "date", "txn_date": "date",
    "transaction date": "date", "transaction_date": "date",
    "trans date": "date", "trans_date": "date",
    "value date": "date", "value_date": "date",
    "posting date": "date", "posting_date": "date",
    "dt": "date",
    "narration": "description", "particulars": "description", "details": "description",
    "transaction details": "description", "transaction_details": "description",
    "remark": "description", "remarks": "description", "transaction remarks": "description",
    "description": "description", "desc": "description",
    "ref no": "reference", "ref_no": "reference",
    "reference no": "reference", "reference_no": "reference", "reference number": "reference",
    "chq no": "reference", "cheque no": "reference", "cheque_no": "reference",
    "chq/ref no": "reference",
    "withdrawal": "debit", "withdrawal amt": "debit", "withdrawal_amt": "debit",
    "debit amount": "debit", "debit_amount": "debit",
    "debit amt": "debit", "debit_amt": "debit",
    "dr": "debit", "dr amount": "debit", "dr_amount": "debit",
    "deposit": "credit", "deposit amt": "credit", "deposit_amt": "credit",
    "credit amount": "credit", "credit_amount": "credit",
    "credit amt": "credit", "credit_amt": "credit",
    "cr": "credit", "cr amount": "credit", "cr_amount": "credit",
    "balance": "balance", "closing balance": "balance", "closing_balance": "balance",
    "running balance": "balance", "available balance": "balance",
    "amount": "amount_raw",
}

# A CSV line with two such cells (substring match) is the header.
CSV_HEADER_WORDS = [
    "date", "txn", "transaction", "narration", "particulars", "debit", "credit", "amount",
    "withdrawal", "deposit", "balance", "description", "details", "dr", "cr",
]

# Whole words counted when scoring a sheet row as header.
SHEET_HEADER_WORDS = [
    "date", "narration", "description", "particulars", "transaction", "amount", "debit",
    "credit", "withdrawal", "deposit", "balance", "txn", "ref", "cheque", "chq", "remarks",
    "details", "dr", "cr",
]

# Normalised header texts of document tables, by role.
DATE_HEADERS = [
    "date", "txn date", "transaction date", "value date", "date & time", "posting date",
    "tran date", "trans date", "txndate",
]
DESC_HEADERS = [
    "narration", "description", "particulars", "transaction details", "details", "remarks",
    "remark", "transaction remarks", "transaction description", "particulars of transaction",
]
DEBIT_HEADERS = [
    "debit", "withdrawal", "withdrawal amt", "dr", "debit amount", "debit amt",
    "withdrawal amount", "debit (inr)", "tran amount dr", "money out",
]
CREDIT_HEADERS = [
    "credit", "deposit", "deposit amt", "cr", "credit amount", "credit amt",
    "deposit amount", "credit (inr)", "tran amount cr", "money in",
]
AMOUNT_HEADERS = [
    "amount", "transaction amount", "net amount", "tran amount", "transaction amt",
]
DRCR_HEADERS = ["dr/cr", "type", "txn type", "transaction type", "cr/dr"]
BALANCE_HEADERS = ["balance", "closing balance", "available balance", "bal", "balance (inr)"]
WALLET_HEADERS = ["date & time", "transaction details", "notes & tags", "your account"]
HEADER_SIGNALS = sorted(
    set(DATE_HEADERS + DESC_HEADERS + DEBIT_HEADERS + CREDIT_HEADERS + AMOUNT_HEADERS
        + BALANCE_HEADERS + DRCR_HEADERS + ["paytm", "note", "ref"])
)

# Month abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Honorifics that start a person name.
HONORIFICS = ["mr", "mrs", "ms", "dr", "prof", "shri", "smt", "sri", "miss"]

# Words that mark a business rather than a person.
BUSINESS_WORDS = [
    "store", "shop", "shops", "mart", "market", "markets", "pvt", "pvt.", "ltd", "ltd.",
    "llp", "co.", "co,", "technologies", "technology", "tech", "services", "service",
    "enterprises", "enterprise", "solutions", "solution", "kitchen", "kitchens", "foods",
    "foodworks", "motors", "automobiles", "clinic", "clinics", "hospital", "hospitals",
    "academy", "academics", "institute", "institution", "school", "college", "university",
    "trading", "traders", "industries", "industry", "corporation", "corp", "incorporated",
    "inc", "limited", "foundation", "trust", "ngo", "agency", "agencies", "group", "media",
    "studio", "studios", "finance", "financial", "capital", "consultancy", "consulting",
    "management", "international", "global", "systems", "system", "networks", "network",
    "digital", "retail", "canteen", "supplier", "restaurant", "company", "mishthan",
    "blenders", "sweets", "bakes", "vypar", "naturals", "hospitality", "kirana", "medicals",
    "readymade", "parlour", "stationers", "photocopy", "hall", "cycle",
]

# Repaired spellings of run-together payee names (upper-case key).
NAME_REPAIRS = {
    "RAWATENTERPRISES": "Rawat Enterprises",
    "RAWAT ENTERPRISES": "Rawat Enterprises",
    "INDIANINSTITUTEOFTECHNOLOGYKANPURHALLACCOUNT": "IIT Kanpur Hall Account",
    "INDIAN INSTITUTE OF TECHNOLOGY KANPUR HALL ACCOUNT": "IIT Kanpur Hall Account",
    "ROOPSAGARFOODWORKSANDTELLPKANPAC": "Roop Sagar Foodworks",
    "SHAKILAHAMAD": "Shakil Ahamad",
    "MYJIO": "MyJio",
    "MYJIOMYJIO": "MyJio",
    "FAMILYRESTAURANT": "Family Restaurant",
    "KISHORECYCLESTORE": "Kishore Cycle Store",
    "ATULPRATAPSINGH": "Atul Pratap Singh",
}

# Typographic characters and their Latin-1 replacement.
LATIN1_REPLACEMENTS = {
    "—": "-", "–": "-", "’": "'", "‘": "'", "“": '"',
    "”": '"', "…": "...", "•": "*", "›": ">", "→": "->",
    "₹": "Rs.",
}

# Words dropped from a payee name before grouping recurring charges.
RECURRING_NOISE = (
    r"\b(payment|pay|via|upi|ref|no|order|id|to|from|the|pvt|ltd|private|limited|india|"
    r"services?|solutions?|technologies?|tech)\b"
)

# Words that mark a subscription.
SUBSCRIPTION_WORDS = (
    r"netflix|spotify|hotstar|disney|prime|youtube|apple|google|zee5|sony|jio cinema|"
    r"jiocinema|coursera|udemy|unacademy|byju|vedantu|gym|cult\.fit|curefit|linkedin|"
    r"microsoft|dropbox|icloud|subscription|renewal|annual|monthly plan|recharge"
)

# Issuers in order of precedence with the texts that identify them.
ISSUER_SIGNALS = [
    ("PhonePe", ["PhonePe", "Phone Pe Transaction", "phonepe.com"]),
    ("Paytm", []),
    ("GPay", []),
    ("HDFC CC", ["HDFC Bank Credit Card", "HDFC Credit Card Statement",
                 "HDFC Bank Ltd. Credit Card"]),
    ("ICICI CC", ["ICICI Bank Credit Card", "ICICI Credit Card Statement"]),
    ("Axis CC", ["Axis Bank Credit Card", "Axis Credit Card Statement"]),
    ("SBI Card", ["SBI Card", "SBI Credit Card", "sbicard.com",
                  "SBI Cards and Payment Services"]),
    ("AmEx", ["American Express", "Amex", "americanexpress.com"]),
    ("HDFC", ["HDFC Bank Limited", "HDFC BANK", "hdfcbank.com", "HDFC Bank Ltd"]),
    ("ICICI", ["ICICI Bank", "iMobile", "icicibank.com", "ICICI Bank Limited"]),
    ("Axis", ["Axis Bank", "axisbank.com", "Axis Bank Limited"]),
    ("Kotak", ["Kotak Mahindra Bank", "kotakbank.com", "Kotak Bank"]),
    ("IndusInd", ["IndusInd Bank", "indusind.com", "IndusInd Bank Limited"]),
    ("SBI", ["State Bank of India", "onlinesbi.com", "State Bank Of India"]),
    ("PNB", ["Punjab National Bank", "PNB", "pnbindia.in"]),
    ("BOB", ["Bank of Baroda", "bankofbaroda.in", "Bank Of Baroda"]),
    ("Canara", ["Canara Bank", "canarabank.in"]),
]
ISSUER_SCOPE = 4000

# Fixed values: (text, searched prefix length or None for all); two hits identify the issuer.
GPAY_SIGNALS = [
    ("Google Pay", 500), ("Transaction statement", 200),
    ("UPITransactionID:", None), ("UPI Transaction ID:", None),
    ("PaidbyIndianBank", None), ("Paid by Indian Bank", None),
    ("PaidtoIndianBank", None), ("Paid to Indian Bank", None), ("Powered by UPI", None),
]
PAYTM_SIGNALS = [
    ("Paytm Payments Bank", 2000), ("paytm.com", 2000), ("Passbook Payments History", None),
    ("UPI Ref No:", None), ("Notes & Tags", 3000), ("PAYTM", 500),
]
