"""Word lists, constants and patterns that results must agree with."""

# Venue keywords
CONFERENCES = ["EMNLP", "ACL", "NAACL", "EACL", "NeurIPS", "ICLR", "ICML", "CVPR", "ECCV", "ICASSP", "AAAI", "AISTATS"]
JOURNALS = ["Nature", "Science", "JMLR", "Journal of Machine Learning Research", "TPAMI", "IEEE Transactions on Pattern Analysis", "Artificial Intelligence Journal", "IJCV", "International Journal of Computer Vision", "Nature Machine Intelligence", "Nature Communications"]
NO_VENUE = ["submitted to", "under review", "preprint"]

# Category codes and their display names
CATEGORIES = {
    "cs.AI": "Artificial Intelligence",
    "cs.LG": "Machine Learning",
    "cs.HC": "Human-Computer Interaction",
    "cs.CL": "Computation and Language",
    "cs.CV": "Computer Vision and Pattern Recognition",
    "cs.RO": "Robotics",
    "cs.IR": "Information Retrieval",
    "cs.NE": "Neural and Evolutionary Computing",
    "cs.SE": "Software Engineering",
    "cs.CR": "Cryptography and Security",
    "cs.DS": "Data Structures and Algorithms",
    "cs.DB": "Databases",
    "cs.SI": "Social and Information Networks",
    "cs.MM": "Multimedia",
    "cs.IT": "Information Theory",
    "cs.PF": "Performance",
    "cs.MA": "Multiagent Systems",
}

# Signals in abstracts
DATASET_PHRASES = ["new dataset", "we release", "we introduce a benchmark", "data collection", "we collected"]
PAPER_TYPES = [
    ("Survey", ["survey", "comprehensive study", "we survey"]),
    ("New Dataset", ["new dataset", "we introduce a benchmark", "we collect"]),
    ("Scale Study", ["we scale", "billion parameter", "x larger", "× larger"]),
    ("New Technique", ["we propose", "novel method", "new architecture", "new approach"]),
    ("Evaluation", ["we evaluate", "empirical study", "analysis of"]),
]
NICHE_WORDS = ["lidar", "3d", "audio", "wireless", "agriculture", "traffic", "physics"]

# Signals in briefs, in order of precedence
INTENTS = [
    ("foundational", ["foundational", "seminal", "classic", "influential", "survey textbook", "original", "pioneering"]),
    ("survey", ["survey", "overview", "comprehensive", "review", "comparison", "benchmark", "evaluation study"]),
    ("diversity", ["diverse", "broad", "various", "multiple areas", "different approaches", "coverage"]),
    ("novelty", ["novel", "latest", "emerging", "state-of-the-art", "sota", "cutting-edge"]),
]
QUALITIES = [
    ("recent", ["recent", "latest", "new", "2024", "2025", "2026", "newest"]),
    ("influential", ["influential", "highly cited", "impactful", "foundational", "popular"]),
    ("emerging", ["emerging", "growing", "rising", "promising", "early-stage"]),
    ("classic", ["classic", "seminal", "original", "historical", "foundational"]),
]
INTENT_WEIGHTS = {"novelty": (1.4, 0.8), "survey": (1.2, 1.2), "diversity": (1.2, 1.0), "foundational": (0.8, 1.4), "specific": (1.0, 1.3), "general": (1.0, 1.0)}
NOT_NAMES = ["the", "a", "an", "using", "applying", "comparing", "combining", "leveraging", "improving", "training", "learning", "relevance", "date", "citation", "impact", "year", "default", "any", "all"]
LEAK_TERMS = ["novel", "new", "recent", "latest", "emerging", "state-of-the-art", "sota", "cutting-edge"]
GENERIC_TERMS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "neural networks", "model", "models", "method", "methods",
    "approach", "approaches", "technique", "techniques", "algorithm", "algorithms", "framework", "frameworks", "system", "systems", "research",
    "paper", "papers", "work", "data", "result", "results", "performance", "analysis", "learning", "training", "evaluation", "optimization",
    "generation", "text",
]
STOP_WORDS = [
    "the", "and", "or", "for", "with", "that", "this", "from", "into", "about", "what", "are", "your", "their", "they", "them", "using", "used",
    "use", "am", "main", "whose", "where", "when", "which", "have", "has", "had", "been", "i", "being", "also", "only", "just", "more", "most",
    "very", "much", "some", "want", "such", "than", "then", "over", "under", "not", "without", "within", "look", "papers", "paper", "interested",
    "looking", "brief", "contribution", "research", "like", "would", "should", "could", "please", "find", "show", "especially", "care", "example",
    "new", "novel", "recent",
]
EXPANSIONS = {
    "RLHF": "Reinforcement Learning from Human Feedback",
    "PPO": "Proximal Policy Optimization",
    "DPO": "Direct Preference Optimization",
    "KTO": "Kahneman-Tversky Optimization",
    "GRPO": "Group Relative Policy Optimization",
    "SFT": "Supervised Fine-Tuning",
}
CONNECTORS = ["of", "the", "from", "and", "for", "in", "on", "with", "a", "an"]
TEMPORAL_HINT = r"(?i)(19|20)\d{2}|\b(recent|latest|current|modern|new|newest|last|past|since|before|after|prior|upcoming|era|decade|year|month|old|classic|historical)\b"
IMPACT_HINT = r"(?i)\b(influential|impact|impactful|cited|citation|seminal|landmark|foundational|pioneering|important|significant|famous|popular|well[- ]known|state[- ]of[- ]the[- ]art|sota)\b"
NOT_HEADER = "WHAT I AM NOT LOOKING FOR"
BRIEF_HEADER = "RESEARCH BRIEF:"
# Exclusions, names and years stated in briefs
INLINE_NOT = r"(?i)\b(?:exclude|excluding|omit|omitting|not including|not interested in|no papers (?:on|about)|nothing (?:on|about))\b[:\s]*([^.\n;]+)"
STATED_BY = r"\b(?:authored\s+by|written\s+by|by)\s+((?:[A-Z][A-Za-z.'\-]+)(?:\s+(?:and\s+|&\s+|,\s*)?[A-Z][A-Za-z.'\-]+)*)"
YEAR = r"(?:19|20)\d{2}"
YEAR_RANGE = rf"(?i)\b(?:from|between)?\s*({YEAR})\s*(?:to|through|until|and|[-–—])\s*({YEAR})\b"
LAST_YEARS = r"(?i)\b(?:last|past)\s+(\d{1,2})\s*years?\b"
SINCE_YEAR = rf"(?i)\b(?:since|after|from|post-?)\s*({YEAR})\b"
UNTIL_YEAR = rf"(?i)\b(?:before|prior to|up to|until|earlier than|pre-?)\s*({YEAR})\b"
NO_BRIEF = "The user did not provide any research brief."

# Numbers
FUSION_K = 45
SCAN_CAP = 20_000
PRIMARY, SECONDARY = 0.68, 0.60
KEYWORDS, MODEL_KEYWORDS, CRITERIA, SHORT_BRIEF = 8, 12, 5, 150
KEEP_VECTOR, KEEP_PAIR, MIN_POOL, MIN_SCORED = 200, 150, 50, 20
PAIR_CHARS = 1500
DEFAULT_WEIGHTS = {"fame": 0.84, "hype": 0.0, "sniper": 0.0, "utility": 0.16}
QUALITY_WEIGHTS = {
    "influential": {"fame": 0.95, "hype": 0.0, "sniper": 0.0, "utility": 0.05},
    "emerging": {"fame": 0.30, "hype": 0.0, "sniper": 0.0, "utility": 0.70},
    "classic": {"fame": 0.90, "hype": 0.0, "sniper": 0.0, "utility": 0.10},
}
RECENCY_BONUS, RECENCY_DAYS, FRESH_DAYS = 15.0, 30, 5
WINDOW_DAYS = {"Last 3 Days": 3, "Last Week": 7, "Last Month": 30, "Last 3 Months": 90}
STAGE_MARKERS = [("Stage 4", 3), ("Cross-Encoder", 3), ("Stage 3", 3), ("MiniLM Stage 2", 2), ("SPECTER2", 2), ("Stage 2", 2), ("RRF Stage 1", 1), ("LanceDB unavailable", 1), ("Stage 1", 1), ("Stage 0", 1)]
PROVIDERS = ["openai", "gemini", "groq", "free", "anthropic", "openrouter", "ollama_local", "ollama_cloud"]
STAGES = ["Fetch & Filter", "Hybrid Retrieval", "Semantic Rerank", "Precision Rerank", "Classify", "Impact Score", "Summarize"]
