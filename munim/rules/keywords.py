"""Fixed keyword phrases of the second classification layer."""

# Fixed values: (phrase, category, subcategory); the longest matching phrase wins.
KEYWORDS = [
    ("food delivery", "Food and Dining", "Food Delivery"),
    ("food order", "Food and Dining", "Food Delivery"),
    ("food court", "Food and Dining", "Restaurant"),
    ("restaurant", "Food and Dining", "Restaurant"),
    ("biryani", "Food and Dining", "Restaurant"),
    ("dhaba", "Food and Dining", "Restaurant"),
    ("bakery", "Food and Dining", "Restaurant"),
    ("canteen", "Food and Dining", "Restaurant"),
    ("tiffin", "Food and Dining", "Restaurant"),
    ("juice", "Food and Dining", "Restaurant"),
    ("groceries", "Shopping and Retail", "Groceries"),
    ("supermarket", "Shopping and Retail", "Groceries"),
    ("vegetables", "Shopping and Retail", "Groceries"),
    ("provisions", "Shopping and Retail", "Groceries"),
    ("online shopping", "Shopping and Retail", "General Online"),
    ("shopping", "Shopping and Retail", "General Online"),
    ("atm withdrawal", "Transfer and Banking", "ATM Withdrawal"),
    ("cash withdrawal", "Transfer and Banking", "ATM Withdrawal"),
    ("airlines", "Transportation", "Flights"),
    ("airline", "Transportation", "Flights"),
    ("airways", "Transportation", "Flights"),
    ("flight", "Transportation", "Flights"),
    ("fastag", "Transportation", "Toll"),
    ("toll", "Transportation", "Toll"),
    ("petrol", "Transportation", "Fuel"),
    ("diesel", "Transportation", "Fuel"),
    ("fuel", "Transportation", "Fuel"),
    ("hotel", "Transportation", "Hotels"),
    ("hostel", "Transportation", "Hotels"),
    ("resort", "Transportation", "Hotels"),
    ("taxi", "Transportation", "Cab & Ride Share"),
    ("cab", "Transportation", "Cab & Ride Share"),
    ("electricity bill", "Utilities and Bills", "Electricity"),
    ("power bill", "Utilities and Bills", "Electricity"),
    ("wifi bill", "Utilities and Bills", "Mobile & Internet"),
    ("internet bill", "Utilities and Bills", "Mobile & Internet"),
    ("mobile bill", "Utilities and Bills", "Mobile & Internet"),
    ("dth recharge", "Utilities and Bills", "Other Bills"),
    ("recharge", "Utilities and Bills", "Mobile & Internet"),
    ("water bill", "Utilities and Bills", "Water"),
    ("gas bill", "Utilities and Bills", "Gas"),
    ("lpg", "Utilities and Bills", "Gas"),
    ("pharmacy", "Healthcare and Medical", "Pharmacy"),
    ("medicine", "Healthcare and Medical", "Pharmacy"),
    ("hospital", "Healthcare and Medical", "Hospital & Clinic"),
    ("clinic", "Healthcare and Medical", "Hospital & Clinic"),
    ("medical", "Healthcare and Medical", "Hospital & Clinic"),
    ("doctor", "Healthcare and Medical", "Hospital & Clinic"),
    ("dentist", "Healthcare and Medical", "Hospital & Clinic"),
    ("lab test", "Healthcare and Medical", "Diagnostics"),
    ("yoga", "Healthcare and Medical", "Fitness"),
    ("gym", "Healthcare and Medical", "Fitness"),
    ("mutual fund sip", "Investment and Savings", "Mutual Funds"),
    ("mutual fund", "Investment and Savings", "Mutual Funds"),
    ("insurance premium", "Investment and Savings", "Insurance"),
    ("insurance", "Investment and Savings", "Insurance"),
    ("investment", "Investment and Savings", "Stocks & Equity"),
    ("demat", "Investment and Savings", "Stocks & Equity"),
    ("fixed deposit", "Investment and Savings", "Fixed Income"),
    ("credit card bill", "Loan and EMI", "Credit Card Bill"),
    ("emi payment", "Loan and EMI", "Personal Loan"),
    ("loan repayment", "Loan and EMI", "Personal Loan"),
    ("home loan", "Loan and EMI", "Home Loan"),
    ("car loan", "Loan and EMI", "Car Loan"),
    ("loan", "Loan and EMI", "Personal Loan"),
    ("house rent", "Transfer and Banking", "Rent"),
    ("maintenance", "Transfer and Banking", "Rent"),
    ("rent", "Transfer and Banking", "Rent"),
    ("bank transfer", "Transfer and Banking", "Bank Transfer"),
    ("fund transfer", "Transfer and Banking", "Bank Transfer"),
    ("neft", "Transfer and Banking", "Bank Transfer"),
    ("rtgs", "Transfer and Banking", "Bank Transfer"),
    ("imps", "Transfer and Banking", "Bank Transfer"),
    ("transfer", "Transfer and Banking", "Bank Transfer"),
    ("upi", "Transfer and Banking", "UPI Transfer"),
    ("salary credit", "Income and Salary", "Salary"),
    ("salary", "Income and Salary", "Salary"),
    ("payroll", "Income and Salary", "Salary"),
    ("dividend", "Income and Salary", "Investment Returns"),
    ("interest credit", "Income and Salary", "Investment Returns"),
    ("school fee", "Education", "School & College"),
    ("college fee", "Education", "School & College"),
    ("university fee", "Education", "School & College"),
    ("tuition", "Education", "School & College"),
    ("course fee", "Education", "Online Learning"),
    ("subscription", "Entertainment and Subscriptions", "Subscription"),
    ("gaming", "Entertainment and Subscriptions", "Gaming"),
    ("concert", "Entertainment and Subscriptions", "Movies & Events"),
    ("movie", "Entertainment and Subscriptions", "Movies & Events"),
]
