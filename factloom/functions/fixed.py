"""Word lists, patterns and limits that results depend on, stated as data."""

# Token categories of source text, in reporting order.
TOKEN_PATTERNS = {
    "function_def": r"\bdef\s+[a-zA-Z_]\w*\s*\(",
    "class_def": r"\bclass\s+[a-zA-Z_]\w*\s*[\(:]",
    "import_stmt": r"^\s*(?:from\s+\S+\s+)?import\s+",
    "decorator": r"^\s*@[a-zA-Z_]\w*",
    "string_literal": r"""(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*')""",
    "numeric_literal": r"\b(?:0[xXoObB])?[\d]+(?:\.[\d]+)?(?:[eE][+-]?\d+)?\b",
    "comment_line": r"#[^\n]*",
    "assignment": r"[a-zA-Z_]\w*\s*(?:[:+\-*/|&^]=|=(?!=))",
    "return_stmt": r"\breturn\b",
    "raise_stmt": r"\braise\b",
    "try_block": r"\btry\s*:",
    "except_block": r"\bexcept\b",
    "with_stmt": r"\bwith\b",
    "yield_expr": r"\byield\b",
    "lambda_expr": r"\blambda\b",
    "list_comp": r"\[.+\bfor\b.+\bin\b.+\]",
    "dict_comp": r"\{.+:\s*.+\bfor\b.+\bin\b.+\}",
    "assert_stmt": r"\bassert\b",
    "global_stmt": r"\bglobal\b",
    "nonlocal_stmt": r"\bnonlocal\b",
    "async_def": r"\basync\s+def\b",
    "await_expr": r"\bawait\b",
}

# Anomaly categories as (category, metric, inverted).
ANOMALY_RULES = [
    ("complexity_spike", "function_def", False),
    ("complexity_spike", "class_def", False),
    ("import_bloat", "import_stmt", False),
    ("comment_desert", "comment_line", True),
    ("error_handling_deficit", "try_block", True),
    ("error_handling_deficit", "except_block", True),
    ("magic_number_overload", "numeric_literal", False),
]
ANOMALY_THRESHOLD = 2.5
ANOMALY_CEILING = 50
MIN_STDEV = 1e-9
SIMILARITY_CUTOFF = 0.8
SIMILAR_PAIR_LIMIT = 50
NGRAM_WINDOW = 4
NGRAM_TOP = 20
MAX_FILE_BYTES = 10_485_760

# Prose domains and their keywords; an earlier domain wins a tie.
DOMAIN_KEYWORDS = {
    "genomics": [
        "dna", "rna", "genome", "gene", "allele", "codon", "nucleotide", "chromosome", "mutation",
        "transcription", "genotype", "phenotype", "exon", "intron", "genomic",
    ],
    "medicine": [
        "patient", "diagnosis", "dosage", "dose", "clinical", "symptom", "treatment", "therapy", "mg/kg",
        "contraindicated", "prescribed", "physician", "comorbidity",
    ],
    "economics": [
        "gdp", "inflation", "equilibrium", "elasticity", "market", "supply", "demand", "interest rate",
        "utility", "macroeconomic", "fiscal", "monetary", "tariff", "recession",
    ],
    "physics": [
        "velocity", "acceleration", "force", "energy", "momentum", "mass", "newton", "joule",
        "thermodynamic", "quantum", "relativity", "torque",
    ],
    "game_engine": [
        "frame", "render", "shader", "entity", "sprite", "collider", "viewport", "raycast",
        "physics tick", "game loop", "actor", "skeletal", "tilemap",
    ],
    "mathematics": [
        "theorem", "integral", "derivative", "matrix", "vector", "polynomial", "proof", "lemma",
        "axiom", "eigenvalue", "differential",
    ],
}
DEFAULT_DOMAIN = "general"

# Document formats by extension, and directories a scan skips.
EXTENSION_FORMATS = {
    ".txt": "text", ".md": "text", ".markdown": "text", ".json": "json",
    ".py": "code:python", ".pyi": "code:python",
    ".cpp": "code:cpp", ".cc": "code:cpp", ".cxx": "code:cpp", ".hpp": "code:cpp", ".hh": "code:cpp",
    ".c": "code:c", ".h": "code:c", ".pdf": "pdf",
}
IGNORED_DIRS = [".git", "__pycache__", ".venv", "venv", "node_modules", "build_artifacts"]
