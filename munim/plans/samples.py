"""Sample narrations used to format test statements."""

from munim.rules.merchants import builtin_merchants

# Narrations as banks print them; {num} is a reference number.
BANK_NARRATIONS = [
    "SWIGGY ORDER #{num}", "ZOMATO FOOD DEL #{num}", "DOMINOS PIZZA #{num}", "MCDONALD'S POS",
    "UBER AUTO #{num}", "OLA CAB #{num}", "IRCTC TICKET #{num}", "METRO CARD RECHARGE",
    "AIRTEL RECHARGE", "TATA POWER BILL", "WATER BILL PAYMENT", "NETFLIX INDIA",
    "BOOKMYSHOW #{num}", "AMAZON PAY #{num}", "FLIPKART #{num}", "CROMA ELECTRONICS",
    "APOLLO PHARMACY POS", "FORTIS HEALTHCARE", "ZERODHA BROKERAGE", "KUVERA SIP",
    "SBI HOME LOAN EMI", "ICICI CREDIT CARD BILL", "ATM WITHDRAWAL", "NEFT TO #{num}",
    "UPI TO #{num}", "RTGS TRANSFER #{num}", "SALARY CREDIT", "CASHBACK CREDIT",
    "UPI/ZOMATO/FOOD DELIVERY", "UPI-SWIGGY-{num}", "UPI/RAMESH KUMAR/{num}",
    "Mr. Suresh Iyer", "Priya Nair", "anil.kumar@okaxis", "anil kumar@okaxis",
    "Sharma Kirana Store", "GLOBALTECH SERVICES PVT LTD", "Auto rickshaw to office",
    "Plumber repair charges at home", "House rent transfer", "Online course subscription fee",
    "Gym membership", "monthly mutual fund sip plan", "Hostel canteen rent", "XQ{num}",
    "POS PURCHASE #{num}", "Amazon Refund Order #{num}", "cash back reward {num}",
]

#: Every merchant of the built-in table occurs, in capitals, in one of three notations.
NARRATIONS = BANK_NARRATIONS + [
    form.format(key.upper()) for (key, _, _), form in zip(
        builtin_merchants(), ["POS {} #{{num}}", "UPI/{}/{{num}}", "ACH {} 12"] * 123)
]
