"""Fixed values. Results must agree with these word lists, patterns and numbers; none is to be derived."""

# Rows that carry a balance over, matched in lower-cased, stripped text.
BALANCE_MARKERS = (
    r"(balance\s+)?(carried|brought)\s+(forward|fwd|f/?wd)",
    r"\bb/?f\b",
    r"\bc/?f\b",
    r"balance\s+(at|on)\s+(start|end|close)",
    r"(opening|closing)\s+balance",
    r"total\s+balance\s+(carried|brought)",
    r"continued\s+(on|over)",
    r"statement\s+continued",
)

# Rows that sum up or explain and are no transactions.
SUMMARY_ROWS = (
    r"personal\s+account\s*(balance|statement)",
    r"(total|net)\s+(balance|outgoings|deposits|income|payments|in|out)",
    r"balance\s+in\s+pots?",
    r"(including|excluding)\s+(all\s+)?pots?",
    r"(regular|savings)\s+pots?\s+(with|provided)",
    r"sort\s*code",
    r"account\s*number",
    r"\biban\b",
    r"\bbic\b",
    r"\bswift\b",
    r"statement\s+period",
    r"(from|to)\s+\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}",
    r"(financial\s+services|compensation\s+scheme|fscs)",
    r"(authorised|regulated)\s+by",
    r"registered\s+(office|in\s+england)",
    r"company\s+(registered|number|no)",
    r"monzo\s+bank\s+limited",
    r"pot\s+(type|name|balance|statement)",
    r"this\s+pot\s+was\s+(closed|opened)",
    r"(important\s+information|compensation\s+arrangements)",
    r"(page|sheet)\s+\d+\s+(of|/)\s+\d+",
)

# Words of which a header line holds two at least.
HEADER_WORDS = (
    "date", "description", "details", "particulars", "narrative",
    "debit", "credit", "paid out", "paid in", "money out", "money in",
    "withdrawal", "deposit", "balance", "amount", "reference", "type",
    "dr", "cr", "running balance", "closing balance", "transaction",
)

# Column roles in order of precedence, with the words that stand for them.
HEADER_ROLES = (
    ("DATE", ("date", "when", "posted")),
    ("VALUE_DATE", ("value date", "value")),
    ("DESCRIPTION", ("description", "details", "particulars", "narrative", "transaction")),
    ("DEBIT", ("debit", "paid out", "money out", "withdrawal", "payments", "dr")),
    ("CREDIT", ("credit", "paid in", "money in", "deposit", "receipts", "cr")),
    ("SINGLE_AMOUNT", ("amount",)),
    ("BALANCE", ("balance", "running", "closing")),
    ("REFERENCE", ("ref", "reference", "cheque")),
    ("TYPE", ("type", "code")),
)

# Roles of the columns of a ready-made table, in order of precedence.
TABLE_ROLES = (
    ("date", ("date", "posted dte")),
    ("description", ("description", "details", "particulars", "narrative", "transaction")),
    ("paid_in", ("paid in", "credit", "money in", "deposit", "receipts")),
    ("withdrawn", ("withdrawn", "debit", "money out", "paid out", "withdrawal", "payments")),
    ("balance", ("balance",)),
    ("amount", ("amount",)),
)

# Document families.
MOTOR_WORDS = (
    r"hire\s+purchase",
    r"conditional\s+sale",
    r"personal\s+contract\s+(purchase|plan|hire)",
    r"\bpcp\b",
    r"\bhp\b(?!\s*(sauce|printer))",
    r"finance\s+agreement",
    r"vehicle\s+registration",
    r"settlement\s+figure",
    r"balloon\s+payment",
    r"guaranteed\s+minimum\s+future\s+value",
    r"optional\s+final\s+payment",
    r"total\s+amount\s+payable",
    r"annual\s+percentage\s+rate",
    r"\bapr\b\s*[\d%]",
    r"motor\s+finance",
    r"vehicle\s+finance",
    r"car\s+finance",
)
BANK_WORDS = (
    r"bank\s+statement",
    r"current\s+account",
    r"savings\s+account",
    r"sort\s+code",
    r"account\s+number",
    r"direct\s+debit",
    r"standing\s+order",
    r"faster\s+payment",
    r"\bbacs\b",
    r"\bchaps\b",
    r"overdraft",
    r"brought\s+forward",
    r"carried\s+forward",
    r"opening\s+balance",
    r"closing\s+balance",
)

# Providers in order of precedence.
PROVIDERS = (
    ("Barclays", (r"barclays", r"barclays\s+bank", r"sort\s+code\s*:\s*20[\-\s]\d{2}[\-\s]\d{2}")),
    ("HSBC", (r"hsbc", r"hsbc\s+uk", r"sort\s+code\s*:\s*40[\-\s]\d{2}[\-\s]\d{2}")),
    ("Lloyds", (r"lloyds", r"lloyds\s+bank", r"lloyds\s+banking\s+group", r"sort\s+code\s*:\s*30[\-\s]\d{2}[\-\s]\d{2}")),
    ("NatWest", (r"natwest", r"national\s+westminster", r"sort\s+code\s*:\s*60[\-\s]\d{2}[\-\s]\d{2}")),
    ("RBS", (r"\brbs\b", r"royal\s+bank\s+of\s+scotland", r"sort\s+code\s*:\s*83[\-\s]\d{2}[\-\s]\d{2}")),
    ("Santander", (r"santander", r"sort\s+code\s*:\s*09[\-\s]\d{2}[\-\s]\d{2}")),
    ("Halifax", (r"halifax", r"sort\s+code\s*:\s*11[\-\s]\d{2}[\-\s]\d{2}")),
    ("Nationwide", (r"nationwide", r"nationwide\s+building\s+society", r"sort\s+code\s*:\s*07[\-\s]\d{2}[\-\s]\d{2}")),
    ("TSB", (r"\btsb\b", r"tsb\s+bank")),
    ("Metro Bank", (r"metro\s+bank", r"sort\s+code\s*:\s*23[\-\s]05[\-\s]\d{2}")),
    ("Monzo", (r"monzo", r"monzo\s+bank", r"sort\s+code\s*:\s*04[\-\s]00[\-\s]04")),
    ("Starling", (r"starling", r"starling\s+bank", r"sort\s+code\s*:\s*60[\-\s]83[\-\s]71")),
    ("Revolut", (r"revolut",)),
    ("Allied Irish", (r"allied\s+irish", r"\baib\b")),
    ("Bank of Ireland", (r"bank\s+of\s+ireland", r"\bboi\b")),
    ("Clydesdale", (r"clydesdale", r"virgin\s+money")),
    ("Co-operative Bank", (r"co[\-\s]?operative\s+bank", r"the\s+co[\-\s]?op\s+bank")),
)

# Signs of a statement's first page, in the top of a page.
PERIOD_SIGNS = (
    r"statement\s+period\s*[:\-]\s*\d",
    r"from\s+\d{1,2}[\s/\-]\w+[\s/\-]\d{2,4}\s+(to|until)",
    r"statement\s+date\s*[:\-]",
    r"period\s+ending\s*[:\-]",
    r"date\s+range\s*[:\-]",
)
OPENING_SIGNS = (
    r"(opening|brought?\s+forward|b/f)\s+(balance|bal)",
    r"balance\s+(brought|carried)\s+forward",
    r"previous\s+balance",
    r"balance\s+at\s+start",
)
ACCOUNT_SIGNS = (
    r"(account\s+(number|no)|sort\s+code|a/c\s+no)",
    r"\d{2}[\-\s]\d{2}[\-\s]\d{2}\s+\d{6,8}",
)
PAGE_ONE_SIGNS = (r"page\s+1\s+of\s+\d+", r"page\s+1\b")

# Customer block.
POSTCODE = r"\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
TITLES = r"^(Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Sir|Lady)\s+"
BOILERPLATE = (
    r"(statement|sort\s*code|account\s*number|account\s*no|"
    r"iban|bic|page\s+\d|sheet\s+\d|branch|telephone|"
    r"barclays|hsbc|lloyds|natwest|rbs|santander|halifax|"
    r"nationwide|monzo|starling|revolut|tsb|metro\s+bank|"
    r"co[\-\s]?operative|allied\s+irish|aib|bank\s+of\s+ireland|"
    r"clydesdale|virgin\s+money|date\s*:)"
)

# Months and the order in which date formats are tried.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_LIKE = (
    r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}",
    rf"\d{{1,2}}\s+({SHORT_MONTHS})",
    r"\d{4}-\d{2}-\d{2}",
    rf"\d{{1,2}}({SHORT_MONTHS})",
)

# Tolerances of the balance check with the confidence each gives.
TOLERANCES = (("0", 0.98), ("0.01", 0.95), ("0.02", 0.90), ("0.05", 0.80), ("1.00", 0.60))

# Weights and thresholds of a document's score.
SCORE_WEIGHTS = (("balance", 0.35), ("amount", 0.25), ("direction", 0.20), ("date", 0.10), ("recon", 0.10))
PASS_AT, WARN_AT, FAIL_AT = 0.85, 0.70, 0.50
