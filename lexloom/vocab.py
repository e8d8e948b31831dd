"""Word lists and lookup tables.

All lists in this module are fixed values: they decide results, entry by entry and in the
order given.
"""

# fixed values: typo -> correction, applied in this order
TYPOS = [
    ("corproate", "corporate"), ("coporate", "corporate"), ("corperate", "corporate"),
    ("taxs", "tax"), ("taxess", "taxes"),
    ("penaltiy", "penalty"), ("penalities", "penalties"),
    ("compiance", "compliance"), ("compilance", "compliance"),
    ("exemtion", "exemption"), ("exmeption", "exemption"),
    ("dedcution", "deduction"), ("deductoin", "deduction"),
    ("violaton", "violation"),
    ("assesment", "assessment"), ("assessement", "assessment"),
    ("liabilty", "liability"),
    ("reveune", "revenue"), ("revneue", "revenue"),
    ("incmoe", "income"), ("incoem", "income"),
]

# fixed values: abbreviation -> expansion, applied in this order after TYPOS
ABBREVIATIONS = [
    ("ct", "corporate tax"), ("vat", "value added tax"), ("fta", "federal tax authority"),
    ("rta", "roads and transport authority"), ("mof", "ministry of finance"),
    ("qfzp", "qualifying free zone person"), ("fy", "fiscal year"), ("ty", "tax year"),
    ("tp", "transfer pricing"), ("pe", "permanent establishment"),
    ("dta", "double taxation agreement"), ("dtaa", "double taxation avoidance agreement"),
    ("poa", "power of attorney"), ("roi", "return on investment"),
    ("p&l", "profit and loss"), ("bs", "balance sheet"),
]

# fixed values: word -> synonyms; only the first two of each are ever added
SYNONYMS = {
    "tax": ["taxation", "levy", "duty", "tariff"],
    "rate": ["percentage", "ratio", "proportion"],
    "corporate": ["company", "business", "enterprise", "firm"],
    "income": ["revenue", "earnings", "profit", "proceeds"],
    "penalty": ["fine", "sanction", "punishment", "fee"],
    "exempt": ["excluded", "waived", "relieved", "free from"],
    "exemption": ["exclusion", "waiver", "relief", "deduction"],
    "deduction": ["allowance", "reduction", "write-off", "credit"],
    "compliance": ["adherence", "conformity", "observance"],
    "violation": ["breach", "infringement", "non-compliance", "offense"],
    "filing": ["submission", "declaration", "return"],
    "assessment": ["evaluation", "determination", "calculation"],
    "liability": ["obligation", "duty", "responsibility"],
    "threshold": ["limit", "minimum", "ceiling", "cap"],
    "resident": ["domiciled", "established", "based"],
    "non-resident": ["foreign", "overseas", "external"],
    "article": ["section", "clause", "provision", "paragraph"],
    "chapter": ["part", "division", "title"],
    "regulation": ["rule", "law", "statute", "ordinance"],
    "decree": ["order", "directive", "resolution"],
    "uae": ["emirates", "united arab emirates", "gulf"],
    "aed": ["dirhams", "dhs", "dirham"],
    "free zone": ["freezone", "fz", "free trade zone", "ftz"],
    "mainland": ["onshore", "local"],
    "entity": ["company", "organization", "establishment", "business"],
    "subsidiary": ["affiliate", "branch", "division"],
    "group": ["conglomerate", "holding", "parent"],
    "transfer pricing": ["arm's length", "intercompany pricing", "TP", "related party transactions"],
    "permanent establishment": ["PE", "fixed place of business", "taxable presence", "business presence"],
    "arm's length": ["market value", "fair value", "comparable price"],
    "related party": ["connected person", "associated enterprise", "affiliate", "controlled entity"],
    "withholding tax": ["WHT", "tax withheld", "withholding", "source taxation"],
    "thin capitalization": ["debt-to-equity", "interest limitation", "EBITDA limitation", "thin cap"],
    "anti-abuse": ["GAAR", "anti-avoidance", "substance over form", "tax avoidance"],
    "gaar": ["general anti-avoidance", "anti-abuse rule", "avoidance rule"],
    "beneficial owner": ["beneficial ownership", "ultimate beneficiary", "UBO"],
    "double taxation": ["DTA", "tax treaty", "bilateral agreement", "double tax relief"],
    "taxable person": ["taxpayer", "tax subject", "person liable to tax"],
    "qualifying income": ["qualifying revenue", "eligible income", "exempt income"],
    "qualifying free zone person": ["QFZP", "qualifying FZ person", "free zone taxpayer"],
    "small business": ["small enterprise", "SME", "micro business", "small business relief"],
    "group relief": ["group loss", "tax consolidation", "fiscal unity", "loss transfer"],
    "economic substance": ["substance requirements", "real presence", "genuine activity"],
}

# fixed values: stop words of the search keyword extractor
SEARCH_STOP_WORDS = [
    "what", "is", "the", "a", "an", "are", "how", "do", "does", "can", "could", "would", "should", "will", "for", "to", "of", "in", "on",
    "at", "by", "with", "about", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "which", "who", "whom", "this", "that", "these", "those",
    "am", "be", "been", "being", "have", "has", "had", "having", "get", "gets", "please", "tell", "me", "explain", "describe", "show",
    "give", "find",
]

# fixed values: stop words of the document pre-filter
PREFILTER_STOP_WORDS = [
    "what", "are", "the", "in", "of", "to", "for", "is", "a", "an", "and", "or", "how", "does", "do", "can", "uae", "under", "about", "say",
    "says",
]

# fixed values: stop words of the keyword reranker
RERANK_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "just", "don", "now", "what", "which", "who", "this", "that",
    "these", "those", "am", "it", "its", "and", "but", "if", "or", "because", "until", "while", "about",
]

# fixed values: query class signals
TECHNICAL_SIGNALS = [
    "transfer pricing", "permanent establishment", "arm's length", "related party",
    "thin capitalization", "anti-abuse", "gaar", "withholding tax", "double taxation",
    "tax treaty", "controlled foreign", "base erosion", "profit shifting", "intercompany",
    "arm's-length", "safe harbour", "safe harbor", "domestic minimum top-up tax", "qdmtt",
    "substance requirement", "economic substance", "beneficial owner",
    "place of effective management", "deemed distribution",
]
PROCEDURAL_SIGNALS = [
    "how to", "how do i", "how can i", "steps to", "process for", "procedure", "file", "submit",
    "register", "apply for", "deadline", "form", "requirement", "what documents", "where do i",
    "when should",
]
DEFINITION_SIGNALS = [
    "what is", "what are", "define", "definition of", "meaning of", "explain", "what does",
    "who is", "who are",
]

# fixed values: (class, intent, top_k, min_similarity, expansion)
QUERY_CLASSES = {
    "technical": ("technical", "analysis", 15, 0.35, "full"),
    "procedural": ("procedural", "procedure", 10, 0.40, "standard"),
    "definitional": ("definitional", "definition", 8, 0.40, "minimal"),
    "short": ("simple", "lookup", 5, 0.45, "minimal"),
    "default": ("simple", "lookup", 10, 0.40, "standard"),
}

# fixed values: reference patterns -> label, extracted in this order
ENTITY_PATTERNS = [
    ("Article ", r"(?i)Article\s+(\d+)(?:\s*\([^)]+\))?"),
    ("Chapter ", r"(?i)Chapter\s+(\d+|[IVXLC]+)"),
    ("Section ", r"(?i)Section\s+([\d.]+)"),
    ("Decree-Law ", r"(?i)(?:Federal\s+)?Decree[- ]Law(?:\s+No\.?)?\s*(\d+)"),
    ("Cabinet Decision ", r"(?i)Cabinet\s+Decision(?:\s+No\.?)?\s*(\d+)"),
    ("Ministerial Decision ", r"(?i)Ministerial\s+Decision(?:\s+No\.?)?\s*(\d+)"),
]

# fixed values: off-topic patterns, matched on the lower-cased query
OFF_TOPIC_PATTERNS = [
    r"write\s+(me\s+)?(a\s+)?code", r"write\s+(me\s+)?(a\s+)?script",
    r"write\s+(me\s+)?(a\s+)?function", r"python\s+code", r"javascript\s+code",
    r"```[\s\S]*```", r"weather\s+(in|today|tomorrow)", r"recipe\s+for", r"how\s+to\s+cook",
    r"translate\s+(this|to)", r"stock\s+price", r"sports\s+score", r"movie\s+review",
]
VAT_PATTERNS = [r"\bvat\b", r"value\s+added\s+tax", r"\b5%\s+tax\b"]

# fixed values: topic words of the keyword intent stage
TOPIC_KEYWORDS = [
    "corporate tax", "ct rate", "tax rate", "taxable income",
    "transfer pricing", "tax group", "free zone", "qualifying free zone",
    "small business relief", "participation exemption", "exempt income",
    "loss carry", "interest deduction", "ebitda", "related party",
    "tax return", "filing", "registration", "fta", "federal tax authority",
    "tax period", "financial year", "deadline",
    "article", "decree-law", "ministerial decision",
    "resident person", "non-resident", "taxable person", "juridical person",
    "permanent establishment", "natural person",
    "mainland", "onshore", "offshore", "deductible", "non-deductible",
    "penalty", "penalties", "violation", "compliance", "audit",
    "gaar", "qfzp", "pe", "apa", "map", "cbcr", "beps", "uct", "ct law",
    "anti-abuse", "anti abuse", "abuse rule", "avoidance",
    "arm's length", "arms length", "market value",
    "withholding", "withholding tax",
    "exempt person", "exemption", "exempt entity",
    "government entity", "government controlled",
    "tax residence", "tax residency", "resident for tax",
    "connected person", "connected parties",
    "qualifying income", "excluded activity", "de minimis",
    "business restructuring", "restructuring relief",
    "transitional rules", "transitional relief",
    "realisation basis", "realization basis",
    "unincorporated partnership", "transparent",
    "extractive business", "natural resources",
]

# fixed values: markers of quote requests, follow-ups and conversational openings
QUOTE_MARKERS = [
    "quote", "exact text", "verbatim", "word for word", "exact wording", "cite exactly",
    "full text of", "complete text", "actual text", "original text", "as written", "copy of",
]
FOLLOW_UP_MARKERS = [
    "this", "that", "it", "more about", "tell me more", "explain more", "dive deeper",
    "implications", "what about", "how about", "can you explain", "elaborate",
]
SKIP_PREFIXES = [
    "what about", "how about", "and", "also", "tell me more", "explain", "elaborate",
    "continue", "yes", "no", "thanks", "thank you",
]
CONTEXT_CONCEPTS = ["GAAR", "anti-abuse", "transfer pricing", "withholding", "corporate tax", "Free Zone"]

# fixed values: task routing indicators
COMPLEX_INDICATORS = [
    "compare", "contrast", "versus", "vs", "difference between", "analyze", "analysis",
    "implications", "consequences", "multiple", "scenarios", "various", "different cases",
    "step by step", "process", "procedure", "exceptions", "interplay", "interaction between",
    "anti-abuse", "gaar", "substance", "economic substance", "transfer pricing",
    "permanent establishment", "what if", "suppose", "assume", "hypothetically", "in case of",
    "scenario where",
]
SIMPLE_INDICATORS = [
    "what is the", "what are the", "define", "rate", "threshold", "deadline", "when", "how much",
    "percentage",
]
LEGAL_INDICATORS = ["anti-abuse", "gaar", "economic substance", "transfer pricing"]

# fixed values: (task type, model, temperature, max tokens)
TASK_CONFIGS = [
    ("classification", "gpt-4o-mini", 0.1, 300),
    ("retrieval", "gpt-4o", 0.2, 500),
    ("simple_generation", "gpt-4o-mini", 0.3, 1500),
    ("complex_generation", "gpt-4o", 0.3, 2000),
    ("legal_analysis", "gpt-4o", 0.2, 3000),
]
# fixed values: (id, name, tier, cost per million tokens)
AVAILABLE_MODELS = [
    ("gpt-4o-mini", "GPT-4o Mini", "fast", 0.15),
    ("gpt-4o", "GPT-4o", "balanced", 2.50),
    ("gpt-4-turbo", "GPT-4 Turbo", "powerful", 10.00),
]
REASONING_PREFIXES = ["o3", "o4", "o1"]

# fixed values: topic, query keywords, figures expected in an answer, description
KEY_FIGURES = [
    ("tax_rate", ["tax rate", "corporate tax", "ct rate", "rate of tax", "tax rates"],
     ["9%", "0%"], "Standard (9%) and below-threshold (0%) rates"),
    ("threshold", ["threshold", "taxable income", "income threshold", "exempt income"],
     ["375,000", "AED 375"], "Taxable income threshold"),
    ("small_business", ["small business", "relief", "small company", "sme"],
     ["3 million", "AED 3"], "Small business relief revenue threshold"),
    ("tax_group", ["tax group", "group relief", "consolidation", "ownership"],
     ["95%"], "Minimum ownership for Tax Group"),
    ("interest_limitation", ["interest", "deduction", "ebitda", "limitation"],
     ["30%", "EBITDA", "12 million"], "Interest deduction limitation (30% of EBITDA or AED 12M)"),
    ("loss_carry", ["loss", "carry forward", "offset", "tax loss"],
     ["75%"], "Maximum loss offset percentage"),
    ("filing", ["filing", "deadline", "return", "submission"],
     ["9 months"], "Filing deadline after tax period"),
    ("registration", ["registration", "register", "registered"],
     ["3 months"], "Registration deadline"),
]
FACT_PATTERN = r"\d+%|\bAED\b|\d+\s*(million|months?|years?|days?)|Article\s+\d+|Section\s+\d+"
TRANSITION_PATTERN = r"^(for example|such as|including|additionally|furthermore|however|therefore)"

# fixed values: phrases and bonuses of the document pre-filter
PREFILTER_PHRASES = [
    "transfer pricing", "free zone", "tax group", "withholding tax", "small business",
    "participation exemption", "qualifying income", "permanent establishment", "anti-abuse",
    "gaar", "general anti", "tax registration", "tax residency", "taxable income",
    "exempt income", "related parties", "connected persons", "qualifying investment",
]

# fixed values: phrases tried last when locating a passage
DISTINCTIVE_PHRASES = [
    "taxable income exceeding", "taxable income not exceeding", "corporate tax at",
    "subject to corporate tax", "tax period", "resident person", "qualifying free zone",
    "small business relief",
]

# fixed values: separators of the recursive splitter, coarsest first
SPLIT_SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", ", ", " ", ""]

# fixed values: accepted upload types and size limits in bytes
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".doc", ".txt", ".md", ".html", ".pptx", ".xlsx"]
SUPPORTED_MIME_TYPES = [
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
    "text/plain",
    "text/markdown",
    "text/html",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
]
OFFICE_EXTENSIONS = [".docx", ".doc", ".pptx", ".xlsx", ".xls", ".odt", ".odp", ".ods"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_STORED_BYTES = 50 * 1024 * 1024

# fixed values: model -> USD per token in and out; other models cost as the last one
MODEL_PRICES = [
    ("gpt-4o", 2.50 / 1_000_000, 10.00 / 1_000_000),
    ("gpt-4o-mini", 0.15 / 1_000_000, 0.60 / 1_000_000),
]
DEFAULT_PRICE_MODEL = "gpt-4o-mini"
EMBEDDING_PRICE_PER_TOKEN = 0.02 / 1_000_000
