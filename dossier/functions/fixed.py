"""Word lists, patterns and formats that results depend on."""

# Sentiment lexicons.
POSITIVE = (
    "increase increased increasing growth strong profitable profitability expand expanded expansion gain gains gained higher outperform "
    "favorable momentum robust solid record advantage benefit benefits benefited excel improved improvement surpassed exceeded exceeding"
).split()
NEGATIVE = (
    "decline declined declining loss losses decrease decreased decreasing drop dropped fall fallen risk risks deficit adverse adversely "
    "impair impaired impairment weak weakness downturn lawsuit default write-off failure pressure pressures challenge challenges penalty "
    "penalties deterioration slowdown curtail uncertainty"
).split()
UNCERTAINTY = (
    "approximate approximately uncertain uncertainty depend dependent project projection projections assume assumption assumptions "
    "fluctuate fluctuation estimate estimates volatile volatility condition conditions potential potentially maybe possible possibly "
    "unknown unpredictable subject"
).split()
LITIGIOUS = (
    "claim claims dispute disputes litigation lawsuit lawsuits investigation investigations proceeding proceedings arbitrate "
    "arbitration breach fine fines penalty penalties injunction alleged allegation subpoena verdict"
).split()

# Section headers, case-insensitive.
SECTION_PATTERNS = {
    "ITEM_1_BUSINESS": r"(?:item\s+1[\.\:]?\s+business|item\s+1\.\s+description\s+of\s+business)",
    "ITEM_1A_RISK_FACTORS": r"(?:item\s+1a[\.\:]?\s+risk\s+factors)",
    "ITEM_7_MDA": r"(?:item\s+7[\.\:]?\s+management(?:'|’)?s\s+discussion\s+and\s+analysis)",
    "ITEM_8_FINANCIALS": r"(?:item\s+8[\.\:]?\s+financial\s+statements)",
    "PART1_ITEM2_MDA": r"(?:part\s+i\s+.*?item\s+2[\.\:]?\s+management(?:'|’)?s\s+discussion)",
    "PART2_ITEM1A_RISK": r"(?:part\s+ii\s+.*?item\s+1a[\.\:]?\s+risk\s+factors)",
    "ITEM_202_EARNINGS": r"(?:item\s+2\.02[\.\:]?\s+results\s+of\s+operations)",
}
WHOLE_DOCUMENT = "FULL_DOCUMENT"
SECTION_CAP, WHOLE_CAP, SECTION_MORE_THAN = 50_000, 100_000, 20

# Money in text, case-insensitive.
MONEY = r"\$\s*([\d\,\.]+)\s*(billion|million|thousand)?"
AMOUNT = r"(\$\s*[\d\,\.]+\s*(?:billion|million|thousand)?)"
REVENUE = r"(?:total\s+net\s+revenues?|total\s+revenues?|net\s+sales|revenues?)\s*(?:was|were|of)?\s*" + AMOUNT
NET_INCOME = r"(?:net\s+income|net\s+loss)\s*(?:was|were|of)?\s*" + AMOUNT
EPS = r"(?:diluted\s+(?:earnings|loss)\s+per\s+share|diluted\s+eps)\s*(?:was|were|of)?\s*\$\s*([\d\.]+)"
CASH = r"(?:cash\s+and\s+cash\s+equivalents?)\s*(?:was|were|of)?\s*" + AMOUNT
EXECUTIVE = r"(?:departure\s+of\s+directors|appointment\s+of|resignation\s+of|retired\s+from\s+the\s+board|appointed\s+(?:mr\.|ms\.|dr\.)\s+[A-Z][a-z]+\s+[A-Z][a-z]+)"
EXECUTIVE_BEFORE, EXECUTIVE_AFTER, BUSINESS_CHARS = 50, 250, 400

# Deals, in order of precedence, case-insensitive.
NAME = r"([A-Z][A-Za-z0-9\.\&]{1,40}(?:\s+[A-Z][A-Za-z0-9\.\&]{1,40})*)"
DEALS = [
    (r"(?:acquired|acquire|purchased|purchase)\s+" + NAME + r"\s+(?:for|at|valued\s+at)\s+" + AMOUNT, "Acquisition"),
    (r"(?:entered\s+into\s+(?:an?\s+)?(?:definitive\s+)?agreement\s+(?:to\s+acquire|with))\s+" + NAME + r"\s+(?:for|valued\s+at)\s+" + AMOUNT, "Material Purchase Agreement"),
    (r"(?:completed\s+the\s+acquisition\s+of)\s+" + NAME + r"(?:\s+(?:for|valued\s+at)\s+" + AMOUNT + r")?", "Acquisition"),
    (r"(?:purchased|purchase|purchasing|procured|buy|buying)\s+(?:[A-Za-z0-9\s]{2,80}?)\s+from\s+" + NAME + r"(?:\s+(?:for|valued\s+at|totaling)\s+" + AMOUNT + r")?", "Vendor Commercial Purchase"),
    (r"(?:master\s+supply\s+agreement|commercial\s+supply\s+contract|vendor\s+agreement)\s+with\s+" + NAME + r"(?:\s+(?:for|valued\s+at|totaling)\s+" + AMOUNT + r")?", "Commercial Supply Agreement"),
]
TRAILING_WORD = r"\s+(?:totaling|valued|for|with|and|in|on|at|by|the|a|an|from)$"
NO_TARGETS = ["the company", "a company", "certain assets", "all assets", "substantially all"]
CONTEXT_BEFORE, CONTEXT_AFTER = 50, 150

# Grades by the least rounded score.
LETTERS = [(93.0, "A+"), (90.0, "A"), (85.0, "B+"), (80.0, "B"), (75.0, "C+"), (70.0, "C"), (60.0, "D")]
FALLING_LETTER = "F"
TONES = ("Positive management tone in filing discussion.", "Cautious or defensive tone detected in management text.", "Neutral management tone.")
CLARITY = ("High readability complexity (Fog index > 20).", "Clear disclosure readability.")
LITIGIOUS_NOTE = "Elevated litigious terms mentioned in risk sections."

# Fixed value: where filings are published.
ARCHIVE_URL = "https://www.sec.gov/Archives/edgar/data"
