"""Fixed regular expressions, written for Java's regex engine.

The values in this file are fixed: they state which texts count as refunds,
noise rows, amounts and so on, and must be these for results to agree.
"""

from munim.rules.tokens import MONTHS

# Money markers.
CURRENCY = r"(?:Rs\.?|₹|INR)"
NUMBER = r"[\d,]+(?:\.\d+)?"
MONTH_NAMES = "|".join(m.title() for m in MONTHS)
MON = "(?:" + MONTH_NAMES + ")"
#: A month by its full name or the first three letters.
MONTH_WORD = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
    r"oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
TIME_OF_DAY = (
    r"(?i)(?:\b|T)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([ap]\.?m\.?)?\s*"
    r"(?:z|utc|gmt|ist|[+-]\d{2}:?\d{2})?$"
)
WEEKDAY_PREFIX = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.\s]+"

# Refunds and reversals.
REFUND = r"(?i)\b(refund|reversal|reversed|cashback|cash[\s\-]?back|reward|revert)\b"

# Table rows that are not transactions.
SKIP_ROW = (
    r"(?i)^(note[:\s]|this payment|self.?transfer|page\s*\d|total\s|opening\s+balance|"
    r"closing\s+balance|statement\s+period|account\s+no|account\s+number|ifsc|branch|"
    r"customer\s+id|mobile|email|address|dear\s|powered\s+by|for\s+any|contact\s+us|"
    r"helpdesk|toll.?free)"
)

# Transfers between own accounts.
SELF_TRANSFER = r"(?i)self\s*transfer"
WALLET_EXCLUDE = r"(?i)(Self.?Transfer|Wallet\s*to\s*Bank\s*Transfer)"

# Payee inside a UPI reference.
UPI_PAYEE = r"(?i)UPI[-/](?:[A-Z0-9]+[-/])?([^@/\-]{3,30})(?:[@/\-]|$)"

# Lines of a cell that hold UPI metadata.
UPI_META = (
    r"(?i)^(UPI\s*(Ref|ID|Ref\s*No|Transaction\s*ID)|Order\s*ID|Bank\s*Ref|Mandate\s*ID|"
    r"Transaction\s*Ref|Ref\s*No\.?)\b"
)
SUBROW_META = r"(?i)(upi ref|upi id|order id|bank ref|transaction id|ref no)"

# Bank-specific description clutter.
SBI_PREFIX = (
    r"(?i)^(BY TRANSFER[\-\s]|TO TRANSFER[\-\s]|INB\s+|NEFT CR[\-\s]+|NEFT DR[\-\s]+|"
    r"RTGS CR[\-\s]+|RTGS DR[\-\s]+|UPI[\-/])"
)
SBI_SUFFIX = r"\s+\d{6,}\s*$"
HDFC_SUFFIX = r"[\-\s]+\d{6,}\s*$"
ICICI_SUFFIX = r"(?i)\s+(REF\s*NO|REF)[\.\s]*[\dA-Z]{6,}\s*$"

# UPI-app statement chrome and lines.
UPI_PAGE_HEADER = (
    r"Transaction statement\n[\d]+,\s*\S+@\S+\n"
    r"(?:Transactionstatementperiod[^\n]+\n[^\n]+\n)?"
    r"Date&time\s+Transactiondetails\s+Amount\n"
)
UPI_PAGE_FOOTER = r"Note:Thisstatement[^\n]+\n[^\n]+\nPage\d+of\d+"
# The same header and footer, line by line.
UPI_HEADER_TITLE = r"^\s*Transaction statement\s*$"
UPI_HEADER_OWNER = r"^\s*\d+,\s*\S+@\S+\s*$"
UPI_HEADER_PERIOD = r"^\s*Transactionstatementperiod."
UPI_HEADER_COLUMNS = r"^\s*Date&time\s+Transactiondetails\s+Amount\s*$"
UPI_FOOTER_NOTE = r"^\s*Note:Thisstatement."
UPI_FOOTER_PAGE = r"^\s*Page\d+of\d+"
UPI_LINE = r"^(\d{2}\w{3},\d{4})\s+(Paidto|Receivedfrom)(.+?)\s+₹([\d,]+\.?\d*)$"

# Wallet statement lines.
WALLET_LINE = (
    r"(?i)^(\d{1,2})\s+(" + MONTH_NAMES + r")\s+(.+?)\s+([+-])\s*Rs\.([\d,]+(?:\.\d+)?)$"
)
WALLET_PERIOD = r"(?i)(\d{1,2})\s+(\w{3,})'(\d{2})\s*-\s*(\d{1,2})\s+(\w{3,})'(\d{2})"
# Parts of it: half a period, lines it may run through, the digits it may begin with at a line's end.
PERIOD_HALF = r"\w{3}'\d{2}"
PERIOD_MARKS = r"\A[\s\d-]*\z"
PERIOD_DAY = r"(\d{1,2}\s*)\z"
YEAR_2000 = r"20(\d{2})"
WALLET_TIME = r"(?i)^\d{1,2}:\d{2}\s*(AM|PM)$"
WALLET_META = (
    r"(?i)^(UPI\s*(ID|Ref\s*No|Transaction\s*ID|Ref)[:\s]|A/c\s*No[:\s]|Page\s*\d|For\s+any|"
    r"Contact\s*Us)"
)
WALLET_ACTION = (
    r"(?i)^(Paid\s+to\s+|Money\s+sent\s+to\s+|Received\s+from\s+|Transferred\s+to\s+|"
    r"Money\s+transferred\s+to\s+|Add\s+Money\s+to\s+|Merchant\s+Payment\s+to\s+)"
)
WALLET_TAG = r"(?i)\s+Tag:\s+.+$"
WALLET_NOTE = r"(?i)\s+Note:\s+.+$"
HASHTAG = r"#\s*(\S+)"
WALLET_CHROME = (
    r"(?i)^(?:Page\s+\d+\s+of\s+\d+|For\s+any\s+queries|Contact\s+Us|"
    r"Passbook\s+Payments\s+History|All\s+payments\s+done\s+by|Date\s*&|Time$|"
    r"Transaction\s+Details|Your\s+Account|Amount$)"
)
BLOCK_START = r"(?i)^\d{1,2}\s+" + MON + r"\b"
DAY_MONTH = r"(?i)(\d{1,2})\s+(" + MONTH_NAMES + r")"
CLOCK = r"(?i)(\d{1,2}):(\d{2})(?:\s*(AM|PM))?"
SIGNED_AMOUNT = r"(?i)([+\-])\s*" + CURRENCY + r"\s*(" + NUMBER + r")"
PERIOD_DATE = r"(?i)\b\d{1,2}\s+(" + MONTH_NAMES + r")['\s\-]+(\d{2})\b"

# Any-format line scanner.
ANY_DATE = (
    r"(?i)(?<!\d)(?:\d{4}[/\-]\d{2}[/\-]\d{2}"
    r"|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}"
    r"|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2}(?!\d)"
    r"|\d{1,2}\s+" + MON + r"[a-z]*\.?\s*\d{4}"
    r"|" + MON + r"[a-z]*\.?\s*\d{1,2},?\s*\d{4}"
    r")(?!\d)"
)
ANY_AMOUNT = (
    r"(?i)(?:" + CURRENCY + r"\s*[\d,]+(?:\.\d+)?"
    r"|[\d,]+(?:\.\d{1,2})?\s*(?:CR|DR)\b"
    r"|[+\-]\s*" + CURRENCY + r"?\s*[\d,]+(?:\.\d+)?)"
)
