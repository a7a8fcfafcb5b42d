"""Fixed values of the synthetic ledger: category weights, amount ranges, merchant texts."""

# Category -> (weight of 100, lowest amount, highest amount, merchant texts).
SPENDING = {
    "Food and Dining": (25, 80, 2500, [
        "SWIGGY ORDER #{num}", "ZOMATO FOOD DEL #{num}", "STARBUCKS INDIA", "KFC ORDER #{num}"]),
    "Transportation": (15, 30, 3500, ["UBER AUTO #{num}", "OLA CAB #{num}", "METRO CARD RECHARGE"]),
    "Shopping and Retail": (15, 200, 8000, ["FLIPKART #{num}", "MYNTRA #{num}", "DMART POS"]),
    "Utilities and Bills": (8, 200, 3000, ["AIRTEL RECHARGE", "TATA POWER BILL"]),
    "Entertainment and Subscriptions": (8, 149, 1500, ["NETFLIX INDIA", "SPOTIFY INDIA"]),
    "Transfer and Banking": (10, 500, 10000, ["ATM WITHDRAWAL", "NEFT TO #{num}"]),
    "Healthcare and Medical": (5, 100, 5000, ["APOLLO PHARMACY POS", "MEDPLUS POS"]),
    "Investment and Savings": (6, 500, 10000, ["ZERODHA BROKERAGE", "KUVERA SIP"]),
    "Loan and EMI": (8, 2000, 15000, ["SBI HOME LOAN EMI", "LIC PREMIUM"]),
}
# Income texts, and salary and further income ranges.
SALARIES = ["SALARY CREDIT", "SALARY CREDIT FROM EMPLOYER", "MONTHLY SALARY NEFT"]
INCOMES = ["FREELANCE PAYMENT NEFT", "INTEREST CREDIT", "CASHBACK CREDIT", "DIVIDEND CREDIT"]
SALARY_RANGE = (45000, 55000)
INCOME_RANGE = (2000, 15000)
OPENING_BALANCE = 85000.0
# Planted unusual rows (day, text, debit).
PLANTED = [
    ("2024-03-15", "UNKNOWN MERCHANT POS 99281", 18500.0),
    ("2024-05-22", "GLOBALTECH SERVICES PVT LTD", 24999.0),
    ("2024-04-10", "CROMA ELECTRONICS POS", 4500.0),
    ("2024-04-12", "CROMA ELECTRONICS POS", 4500.0),
    ("2024-02-08", "OBSCURE TRADING CO NEFT", 21000.0),
]
YEAR, MONTHS, ROWS = 2024, 6, 800
