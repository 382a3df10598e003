"""Word lists, labels, thresholds and texts that decide results.

Everything here is data. It is kept together, in natural order, so that a reader can compare a
result with the value that produced it.
"""

# ---- fixed values: dataset columns -------------------------------------------------------------

COLUMN_SYNONYMS = {
    "question": ["question", "clue", "prompt", "text"],
    "answer": ["answer", "response", "correct_answer", "solution"],
    "category": ["category", "subject", "topic", "theme"],
    "value": ["value", "points", "dollar_value", "amount", "worth"],
    "air_date": ["air_date", "date", "broadcast_date", "show_date"],
    "show_number": ["show_number", "episode", "episode_number", "show_id"],
    "round": ["round", "game_round", "round_type"],
}
INGEST_ALIASES = {
    "clue": "question",
    "response": "answer",
    "correct_answer": "answer",
    "question_text": "question",
}
REQUIRED_COLUMNS = ["category", "question", "answer"]
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy-M-d H:m:s", "MMMM d, yyyy"]
HTML_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
ROUND_ALIASES = {
    "jeopardy": "Jeopardy!",
    "single": "Jeopardy!",
    "double": "Double Jeopardy!",
    "double jeopardy": "Double Jeopardy!",
    "final": "Final Jeopardy!",
    "final jeopardy": "Final Jeopardy!",
}

# ---- fixed values: validation ------------------------------------------------------------------

KNOWN_CATEGORIES = [
    "SCIENCE", "HISTORY", "LITERATURE", "GEOGRAPHY", "SPORTS", "MOVIES", "MUSIC", "TELEVISION",
    "POLITICS", "FOOD & DRINK", "POTPOURRI", "BEFORE & AFTER", "RHYME TIME", "WORDPLAY",
    "WORLD CAPITALS", "AMERICAN LITERATURE", "WORLD HISTORY", "THE MOVIES", "SCIENCE & NATURE",
]
ERA_VALUES = {
    "classic": [100, 200, 300, 400, 500],
    "modern": [200, 400, 600, 800, 1000],
    "double": [400, 800, 1200, 1600, 2000],
    "all": [100, 200, 300, 400, 500, 600, 800, 1000, 1200, 1600, 2000],
}
DIFFICULTY_LEVELS = ["Easy", "Medium", "Hard", "Unknown"]
EARLIEST_AIR_DATE = "1964-01-01"
# Wording of validation issues; {x} stands for a number or a name.
ISSUE_TEXTS = {
    "question_short": "Question too short ({x} chars, minimum 10)",
    "question_long": "Question too long ({x} chars, maximum 500)",
    "question_end": "Question should end with proper punctuation or be properly quoted",
    "question_html": "Question contains HTML tags",
    "question_gaps": "Question contains excessive whitespace",
    "question_marks": "Question contains multiple question marks",
    "question_style": "Question may not follow typical Jeopardy format",
    "question_empty": "Question is empty or not a string",
    "answer_blank": "Answer is empty after stripping whitespace",
    "answer_long": "Answer too long ({x} chars, maximum 200)",
    "answer_html": "Answer contains HTML tags",
    "answer_gaps": "Answer contains excessive whitespace",
    "answer_style": "Answer format may be incorrect for Jeopardy style",
    "answer_empty": "Answer is empty or not a string",
    "category_short": "Category too short ({x} chars, minimum 2)",
    "category_long": "Category too long ({x} chars, maximum 50)",
    "category_chars": "Category contains invalid characters",
    "category_unknown": "Category '{x}' not in predefined valid categories",
    "category_empty": "Category is empty or not a string",
    "value_low": "Value must be positive (got {x})",
    "value_high": "Value unusually high ({x}), maximum expected is 10000",
    "value_type": "Value '{x}' cannot be converted to integer",
    "date_format": "Invalid date format",
    "date_early": "Date {x} is before Jeopardy started (1964)",
    "date_late": "Date {x} is in the future",
}

# ---- fixed values: sampling --------------------------------------------------------------------

Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
DEFAULT_Z = 1.96
MIN_SAMPLE = 30
BALANCED_DIFFICULTY = {"Easy": 0.4, "Medium": 0.4, "Hard": 0.2}
MODE_PRESETS = {"quick": 50, "standard": 200, "comprehensive": 1000}
PRESET_STRATA = ["category", "difficulty_level"]
PRESET_SEED = 42

# ---- fixed values: response parsing ------------------------------------------------------------

QUESTION_WORDS = ["what", "who", "where", "when", "why", "how"]
QUESTION_VERBS = ["is", "are", "was", "were", "would"]
UNCERTAINTY_PHRASES = [
    "i think", "i believe", "possibly", "probably", "likely", "might be", "could be",
    "seems to be", "appears to be", "i'm not sure", "not certain", "uncertain", "maybe",
    "perhaps", "presumably", "supposedly", "allegedly",
]
REFUSAL_PHRASES = [
    "i don't know", "i'm not sure", "cannot answer", "don't have enough information",
    "insufficient information", "unable to determine", "unclear", "ambiguous", "sorry",
    "apologize", "can't help",
]
REASONING_PATTERNS = [
    r"because\s+", r"since\s+", r"let me think\s+", r"step by step", r"analysis:",
    r"reasoning:", r"explanation:", r"this is because", r"the answer is.*because",
]
ANSWER_PREFIXES = [
    r"^(answer|response|reply):\s*", r"^(the answer is):\s*", r"^(my answer is):\s*",
    r"^(i think the answer is):\s*", r"^(final answer):\s*",
]
DIRECT_PREFIX = r"^(the answer is|it is|this is)\s+"
QUESTION_TYPE = "jeopardy_format"

# ---- fixed values: answer matching -------------------------------------------------------------

ABBREVIATIONS = {
    "usa": ["united states", "united states of america", "america"],
    "uk": ["united kingdom", "britain", "great britain"],
    "nyc": ["new york city", "new york"],
    "la": ["los angeles"],
    "sf": ["san francisco"],
    "dc": ["washington dc", "washington d.c."],
    "jr": ["junior"],
    "sr": ["senior"],
    "dr": ["doctor"],
    "mr": ["mister"],
    "mrs": ["missus"],
    "ms": ["miss"],
    "st": ["saint", "street"],
    "ave": ["avenue"],
    "blvd": ["boulevard"],
    "rd": ["road"],
    "ft": ["fort"],
    "mt": ["mount", "mountain"],
}
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40",
    "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000",
}
NUMBER_PATTERNS = [
    r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b",
    r"\b\d+\b",
    r"\$\d+(?:,\d{3})*(?:\.\d{2})?\b",
]
YEAR_PATTERN = r"\b(1\d{3}|20\d{2})\b"
FUZZY_THRESHOLD = 0.80
SEMANTIC_THRESHOLD = 0.70
NUMBER_THRESHOLD = 0.80
CONFIDENCE_THRESHOLD = 0.70
CREDIT_TIERS = [(0.90, 1.0), (0.70, 0.85), (0.50, 0.65), (0.30, 0.45)]
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd",
    "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers",
    "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should",
    "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# ---- fixed values: metrics ---------------------------------------------------------------------

VALUE_BUCKETS = ["Low ($1-399)", "Medium ($400-799)", "High ($800+)"]
BASELINE_COST_PER_CORRECT = 0.01
MAX_ACCEPTABLE_SECONDS = 30.0
DEFAULT_QUESTION_VALUE = 400

# ---- fixed values: prices ----------------------------------------------------------------------

TIER_MULTIPLIERS = {"free": 0.0, "basic": 1.0, "premium": 0.8, "enterprise": 0.6}
PER_TOKEN_PRICE_LIMIT = 0.01
LONG_CONTEXT_TOKENS = 100_000
# model id, display name, provider, context window, input and output price per 1M tokens,
# streaming, capabilities
STATIC_MODELS = [
    ("openai/gpt-3.5-turbo", "GPT-3.5 Turbo", "openai", 4096, 0.5, 1.5, True,
     ["chat", "reasoning"]),
    ("openai/gpt-4", "GPT-4", "openai", 8192, 30.0, 60.0, True,
     ["chat", "reasoning", "analysis"]),
    ("openai/gpt-4-turbo", "GPT-4 Turbo", "openai", 128000, 10.0, 30.0, True,
     ["chat", "reasoning", "analysis", "long-context"]),
    ("anthropic/claude-3-haiku", "Claude 3 Haiku", "anthropic", 200000, 0.25, 1.25, True,
     ["chat", "reasoning", "analysis", "long-context"]),
    ("anthropic/claude-3-sonnet", "Claude 3 Sonnet", "anthropic", 200000, 3.0, 15.0, True,
     ["chat", "reasoning", "analysis", "long-context", "creative"]),
    ("anthropic/claude-3.5-sonnet", "Claude 3.5 Sonnet", "anthropic", 200000, 3.0, 15.0, True,
     ["chat", "reasoning", "analysis", "long-context", "creative"]),
    ("anthropic/claude-sonnet-4", "Claude Sonnet 4", "anthropic", 200000, 3.0, 15.0, True,
     ["chat", "reasoning", "analysis", "long-context", "creative"]),
    ("anthropic/claude-3-opus", "Claude 3 Opus", "anthropic", 200000, 15.0, 75.0, True,
     ["chat", "reasoning", "analysis", "long-context", "creative", "complex-reasoning"]),
    ("meta-llama/llama-2-70b-chat", "Llama 2 70B Chat", "meta", 4096, 0.7, 0.8, True,
     ["chat", "reasoning"]),
    ("mistralai/mixtral-8x7b-instruct", "Mixtral 8x7B Instruct", "mistral", 32768, 0.24, 0.24, True,
     ["chat", "reasoning", "multilingual"]),
    ("google/palm-2-chat", "PaLM 2 Chat", "google", 8192, 0.5, 0.5, False,
     ["chat", "reasoning"]),
]
# Replacements tried in this order when neither price list knows an id.
ALTERNATIVE_ID_REPLACEMENTS = [
    ("anthropic/claude-sonnet-4", "anthropic/claude-3.5-sonnet"),
    ("claude-sonnet-4", "claude-3.5-sonnet"),
    ("claude-sonnet", "claude-3.5-sonnet"),
]

# ---- fixed values: prompt texts ----------------------------------------------------------------

SYSTEM_PROMPTS = {
    "basic_qa": (
        "You are an expert quiz contestant. Answer the question accurately and concisely."
    ),
    "jeopardy_style": (
        "You are a Jeopardy! contestant. Respond to each clue in the form of a question, "
        "starting with 'What is', 'Who is', 'Where is', etc. as appropriate."
    ),
    "chain_of_thought": (
        "You are a Jeopardy! contestant. Think through the clue step by step, "
        "then provide your final answer in the form of a question."
    ),
    "few_shot": (
        "You are a Jeopardy! contestant. Study the examples below, then answer "
        "the new question in the same format."
    ),
    "instructional": (
        "You are participating in Jeopardy!, a quiz show where contestants are given "
        "answers and must respond with the corresponding question. Your response must "
        "be in the form of a question (e.g., 'What is...?', 'Who is...?', 'Where is...?')."
    ),
}
FEW_SHOT_EXAMPLES = [
    {"category": "WORLD CAPITALS", "value": "$400",
     "question": "This South American capital is known as the 'Paris of South America'",
     "correct_answer": "What is Buenos Aires?"},
    {"category": "SCIENCE", "value": "$600",
     "question": "This element has the chemical symbol 'Au'",
     "correct_answer": "What is gold?"},
    {"category": "LITERATURE", "value": "$800",
     "question": "This author wrote 'Pride and Prejudice'",
     "correct_answer": "Who is Jane Austen?"},
]
THOUGHT_STEPS = [
    "Let me think through this step by step:", "1. Analysis:", "2. Key information:",
    "3. Reasoning:", "4. Final answer:",
]
INSTRUCTION_LINES = [
    "INSTRUCTIONS:",
    "- Read the clue carefully",
    "- Identify what type of answer is expected",
    "- Respond in question format (What is...? Who is...? etc.)",
    "- Be specific and accurate",
    "- If unsure, make your best educated guess",
]
