"""Fixed user-facing texts; ``{name}`` is replaced by a formatted value."""

# Score tips.
TIP_SAVINGS = "Increase savings rate from {rate}% to 20% → +{gain} points"
TIP_TOP = "Reduce top category concentration from {top}% → +{gain} points potential"
TIP_ANOMALY = "Review {n} flagged {noun} → up to +{gain} points if resolved"
TIP_TREND = "Forecast shows spending trending up {change}% → reduce to stabilise score"

# Key insights.
SURPLUS = "Savings rate {rate}% — surplus {net}"
BELOW_TARGET = "Savings rate {rate}% — financial planners recommend 20% or more"
DEFICIT = "Deficit of {net} — spending exceeds income"
OUTFLOWS = "Total outflows {debits} across {n} transactions"
TOP_SPEND = "{category} is top spend — {amount} ({share}%)"
UNUSUAL = "{n} unusual {noun} — {amount} flagged"
NO_UNUSUAL = "No anomalous activity detected"
RISING = "Spend forecast rising {change}% next month — tighten budget"
FALLING = "Spend forecast falling {change}% — positive trend"

# Narrative.
PERIOD = "Over {n} {noun}"
STORY_INCOME = (
    "{period}, you earned {credits} and spent {debits}, {direction} {net} ({rate}% {label}) "
    "across {n} transactions."
)
STORY_SPEND = "{period}, {n} transactions totalling {debits} in outflows were recorded."
STORY_TWO = "{first} ({a}) and {second} ({b}) together represent {share}% of total outflows."
STORY_ONE = "{first} was the single largest category at {a}."
STORY_UNUSUAL = "{n} {noun} flagged as unusual — review the Anomalies tab for details."
STORY_FORECAST = "Next month's projected spend is {amount} — plan accordingly."
STORY_CALM = "Spending patterns are consistent with no major irregularities detected."

# Spending personalities.
WEEKEND_DINER = "{weekend}% of your Food spending occurs on weekends."
BRAND_LOYALIST = "{category} accounts for {share}% of total spend, concentrated on one merchant."
EXPERIENCE_SPENDER = "{category} is your largest category at {share}% of total outflows."
FREQUENT_TRAVELER = "You spend most on {category} — {share}% of all outflows."
DIVERSIFIED = "No single category exceeds 30% of spend. Highest is {category} at {share}%."
FOCUSED = "{category} dominates at {share}% of spend, peaking on {day}s."
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Advice.
ADVICE_GOOD = (
    "You're saving {rate}% of your income — that's genuinely good. Here's what the numbers say:"
)
ADVICE_ROOM = "Saving {rate}% of income. Room to grow — let's see where the leaks are:"
ADVICE_SHORT = (
    "Spending is outpacing income by {net}. Worth addressing now before it compounds:"
)
ADVICE_BLIND = "Here's the read on {n} transactions:"
ADVICE_NET = "- Income {credits} vs spend {debits} — net {side} of {net}."
ADVICE_HEAVY = (
    "- {category} is eating {amount} ({share}% of spend) — "
    "that's a concentrated outflow worth reviewing."
)
ADVICE_SPREAD = (
    "- Biggest category is {category} at {amount} ({share}%) — "
    "spending looks reasonably spread out."
)
ADVICE_UNUSUAL = (
    "- {n} {noun} flagged as unusual — worth a quick check to rule out errors or one-offs."
)
ADVICE_FORECAST = (
    "- Next month's spend is forecast at {amount} — "
    "set that aside now so it doesn't catch you off guard."
)
NEXT_TRIM = (
    "**Next step:** Trim {category} spending by 15–20% to push your savings rate past the 20% mark."
)
NEXT_PARK = (
    "**Next step:** Park the surplus in a SIP or RD — "
    "idle savings in a current account lose value to inflation."
)
NEXT_CUT = (
    "**Next step:** Identify one discretionary category you can cut this month to stop the shortfall."
)
NEXT_LINK = (
    "**Next step:** Link your income data for a complete picture — "
    "it'll make these insights a lot sharper."
)
