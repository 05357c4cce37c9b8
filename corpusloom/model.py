"""Schemas, limits and defaults of the analysis: files, chunks, findings, sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("context", T.StringType())])
FINDING = T.StructType(
    [
        T.StructField("point", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("verification_required", T.BooleanType()),
    ]
)
CHUNK_RESULT = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("findings", T.ArrayType(FINDING)),
        T.StructField("missing_info", T.ArrayType(T.StringType())),
        T.StructField("suggested_queries", T.ArrayType(T.StringType())),
        T.StructField("partial_answer", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

PHASES = ("initialized", "scouting", "chunking", "mapping", "reducing", "completed")
SCAN_MODES = ("full", "lazy", "targeted")

MIN_CHUNK, MAX_CHUNK, MAX_OVERLAP = 50_000, 300_000, 50_000
WARN_CHUNKS, MOST_CHUNKS = 100, 500
PREVIEW_CHARS, OUTPUT_CHARS = 50_000, 500_000
GREP_MATCHES, GREP_WINDOW = 20, 100
FILE_BYTES = 10 << 20
PROGRESS_BYTES = 10 << 20
TREE_ENTRIES = 10_000
CHUNK_TOKENS, TOKEN_MARGIN = 40_000, 0.8

# Extensions by kind of content, and the chunk size of each kind.
CODE_EXTENSIONS = (".py", ".java", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml", ".toml")
CHUNK_SIZES = {
    **dict.fromkeys(CODE_EXTENSIONS, 100_000),
    **dict.fromkeys(CONFIG_EXTENSIONS, 80_000),
    ".xml": 100_000,
    ".sql": 100_000,
    ".md": 200_000,
    ".rst": 200_000,
    ".txt": 250_000,
    ".html": 150_000,
}
DEFAULT_CHUNK_SIZE = 150_000
# Languages of extensions.
LANGUAGES = {".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go"}
PRUNED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build", "target", ".idea", ".vscode", ".mypy_cache",
    ".pytest_cache", ".tox", ".cache", "coverage",
)

IGNORED_GLOBS = (
    "*.pyc", "*.pyo", "*.log", "*.tmp", "*.swp", "*.lock", "*.min.js", "*.map", ".env", ".env.*", "*.pem", "*.key", "*.p12", ".DS_Store", "*.egg-info", "*.class",
)


@dataclass(frozen=True)
class Config:
    """How a session scans, cuts, retries and escalates; kept with the session."""

    chunk_size: int = DEFAULT_CHUNK_SIZE
    chunk_overlap: int = 0
    adaptive_chunking: bool = False
    max_retries: int = 3
    batch_size: int = 5
    enable_escalation: bool = True
    max_escalation_ratio: float = 0.15
    max_cost: float = 5.0
    previous_session: str | None = None
    scan_mode: str = "full"
    lazy_depth: int = 3
    lazy_file_limit: int = 50
    target_paths: tuple[str, ...] = ()
