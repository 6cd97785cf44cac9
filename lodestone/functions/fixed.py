"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# Windows and limits
CHUNK_LINES, CHUNK_OVERLAP, MIN_CHUNK_LEN, MAX_CHUNK_CHARS = 40, 15, 30, 6000
MAX_FILE_BYTES = 1048576
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, CANDIDATE_POOL, HYBRID_ALPHA = 60, 60, 0.5
MIN_RELEVANCE, RELATIVE_FLOOR, RERANK_TOP = 0.22, 0.4, 30
SYMBOL_BOOST, PATH_BOOST, LATE_WEIGHT, NEIGHBOUR_DECAY = 1.0, 0.5, 0.4, 0.85
PAD_LINES, WHOLE_FILE_HITS, WHOLE_FILE_CHARS = 30, 2, 80000
NEIGHBOUR_LIMIT, REPO_MAP_SYMBOLS, REPO_MAP_FILES = 12, 30, 40
CACHE_THRESHOLD, CACHE_TTL_S, CACHE_ENTRIES = 0.95, 3600, 200
DEBOUNCE_S, STORM_WINDOW_S, STORM_THRESHOLD, REBUILD_GAP_S = 2, 2, 30, 5
ANSWER_NOW, AGENTIC, CLARIFY = 0.72, 0.30, 0.10

LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp",
    "java": "java", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "sql": "sql", "md": "markdown", "sh": "bash", "bash": "bash",
    "ps1": "powershell", "bat": "batch", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "xml": "xml",
}
INDEXED_SUFFIXES = ["py", "js", "ts", "jsx", "tsx", "go", "rs", "cpp", "c", "h", "hpp", "java", "cs", "php", "rb", "swift", "kt", "scala", "r", "jl", "json", "yaml", "yml", "toml", "ini", "xml", "md", "sql", "graphql", "proto", "sh", "bash", "ps1", "bat"]
IGNORED_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt", "target", "bin", "obj", ".idea", ".vscode", "coverage", ".pytest_cache", "migrations", ".terraform", "codebase_index"]
IGNORED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "Pipfile.lock", "uv.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "tsconfig.tsbuildinfo", ".DS_Store"]
IGNORED_ENDINGS = [".min.js", ".min.css", ".bundle.js", ".chunk.js", ".map", ".tsbuildinfo"]

# Names of tests, declarations and statements
TEST_PATH = r"(?i)(^|[\\/])(tests?|__tests__|spec|specs|e2e|integration|features)[\\/]|[._-](test|tests|spec|specs|e2e)\.[^.]+$|^test_[^.]+\.py$|_test\.go$"
TEST_NAME = r"^(test_|test[A-Z]|it_should_|describe_|spec_)|_test$"
DECLARATION = r"^(def\s+\w+|async\s+def\s+\w+|class\s+\w+|function\s+\w+|interface\s+\w+|type\s+\w+|export\s+(default\s+)?(async\s+)?function|fn\s+\w+|struct\s+\w+|trait\s+\w+|enum\s+\w+|@\w+)"
STATEMENT = r"\b(return|if|for|while|try|throw|raise|yield|await|console\.|print\(|self\.|this\.)\b"

# Languages that are read by the patterns of another one
DEFINITION_FAMILY = {"javascript": "typescript", "tsx": "typescript", "jsx": "typescript", "csharp": "java", "kotlin": "java", "c": "cpp"}
IMPORT_FAMILY = {"javascript": "typescript", "tsx": "typescript", "jsx": "typescript", "c": "cpp"}
INHERIT_FAMILY = {"javascript": "typescript", "tsx": "typescript"}
# One definition per line and language: (language, kind, pattern); group 1 is the name
DEFINITIONS = [
    ("python", "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("python", "class", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b"),
    ("typescript", "function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("typescript", "class", r"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("typescript", "interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("typescript", "type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("typescript", "enum", r"^\s*(?:export\s+)?enum\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("typescript", "const", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:\(|function)"),
    ("go", "function", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("go", "type", r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)\s+(?:struct|interface)"),
    ("rust", "function", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("rust", "struct", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("rust", "enum", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?enum\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("rust", "trait", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?trait\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("java", "class", r"^\s*(?:public|private|protected)?\s*(?:abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("java", "interface", r"^\s*(?:public|private|protected)?\s*interface\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("cpp", "function", r"^\s*(?:[\w:<>*&]+\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s*\{"),
    ("cpp", "class", r"^\s*(?:class|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"),
]
IMPORTS = [
    ("python", r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.,\s]+))"),
    ("typescript", r"^\s*(?:import|export)\s+(?:.*?from\s+)?[\"']([^\"']+)[\"']()"),
    ("go", r"^\s*import\s+\"([^\"]+)\"()"),
    ("rust", r"^\s*use\s+([\w:]+)()"),
    ("java", r"^\s*import\s+([\w.]+);()"),
    ("csharp", r"^\s*using\s+([\w.]+);()"),
    ("kotlin", r"^\s*import\s+([\w.]+)()"),
    ("cpp", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]()"),
]
# A list of imports in parentheses: what opens it, what closes it, and the modules on its lines
GROUP_OPENS, GROUP_CLOSES, GROUP_MEMBER = r"\bimport\s+\(", r"\)", r"\"([^\"]+)\""
INHERITS = [
    ("python", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]+)\)"),
    ("typescript", r"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\s+extends\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("java", r"^\s*(?:public|private|protected)?\s*(?:abstract\s+)?class\s+([A-Za-z_][A-Za-z0-9_]*)\s+extends\s+([A-Za-z_][A-Za-z0-9_]*)"),
]

# Query analysis
PATH_MENTION = r"[A-Za-z0-9_./\\-]+\.[A-Za-z]{1,5}\b"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
MIXED_CASE = r"[A-Z][a-z]+[A-Z]|[a-z]+[A-Z][a-z]"
KNOWN_FILES = ["readme", "makefile", "dockerfile", "procfile", "gemfile", "cargo", "brewfile", "jenkinsfile", "vagrantfile", "pipfile", "changelog", "contributing", "license", "authors", "codeowners"]
PROSE_WORDS = (
    "how why what when where which who whose does is are was were be been being the a an of in on at to for with and or but not no yes do did done doing have has had should would could can will may might must this that these those such "
    "i me my we our you your it its they their find show tell explain describe list give make fix add remove change update create delete implement bug error issue problem feature function file code line lines from into out up down over under "
    "use uses used using work works working worked if then else while until between across through during before after really actually currently previously module modules package packages class classes method methods type types import imports export exports"
).split()
FILLER_WORDS = "how does do is are was were the a an of to for with in on at and or what where when why who this that these those show tell explain describe find me us you i we really actually ? !".split()
SUFFIX_HINTS = ["implementation", "function", "logic", "definition", "handler"]
PRONOUNS = r"(?i)\b(it|this|that|these|those|them|they|their|its|above|previous|same|here)\b"
CONTEXT_STOP = "where which their about there would could should these those above other every after while until since based".split()
OVERVIEW_PHRASES = [
    "what is this", "what's this", "whats this", "what does this repo", "what does this project", "summarize", "summarise", "summary of", "overview of", "describe the project", "describe this repo", "describe the codebase", "describe the code",
    "content of this", "contents of this", "what's in this repo", "whats in this repo", "what is in this repo", "explain the project", "explain this repo", "explain this codebase", "tell me about this", "tldr", "high level",
]
DEBUG_PHRASES = ["error", "failing", "doesn't work", "doesnt work", "not working", "bug", "broken", "exception", "crash", "stack trace", "stacktrace", "regression", "fix the", "why is", "why does", "why doesn't", "throws", "throwing", "raise", "raises"]
HOW_PHRASES = ["how does", "how is", "how do", "how to", "how can", "how would", "where does", "what happens when", "walkthrough", "explain how", "walk me through"]
IMPLEMENT_PHRASES = ["implement", "create a", "create the", "build a", "build the", "write a", "write the", "generate a", "generate the", "add a feature", "add the feature", "develop a", "develop the", "code a", "code the", "make a", "make the"]
REFACTOR_PHRASES = ["refactor", "refactoring", "improve", "clean up", "cleanup", "simplify", "optimise", "optimize", "reorganize", "reorganise", "restructure", "extract", "decouple", "modularize"]
WRITE_PHRASES = [
    "add some content", "add content", "add a section", "add section", "add to readme", "add to the readme", "add to the file", "add to file", "update readme", "update the readme", "update the file", "update the doc", "edit readme", "edit the readme", "edit the file",
    "modify the file", "modify readme", "write to the file", "write to file", "append to", "insert into", "add a note", "add notes", "add documentation", "add docs", "add a description", "add description", "add info", "add information", "add details", "add example", "add examples", "add usage",
]
#: route -> (hyde, multi query, seed strategy, top k, seed token budget)
ROUTE_PLANS = {
    "OVERVIEW": (False, False, "map_only", 8, 6000), "EXACT_STRING": (False, False, "minimal", 12, 6000), "WRITE_FILE": (False, False, "minimal", 4, 4000), "FILE_LOOKUP": (False, False, "map_only", 10, 8000),
    "SYMBOL_LOOKUP": (False, False, "retrieval_only", 15, 12000), "DEBUG": (True, True, "both", 30, 35000), "IMPLEMENT_FEATURE": (False, True, "both", 20, 25000), "REFACTOR": (False, True, "both", 20, 25000),
    "HOW_X_WORKS": (True, True, "both", 30, 30000), "DEFAULT": (False, False, "both", 30, 30000),
}
INTENT_BOOSTS = [
    ("DEBUG", "change", 1.6), ("DEBUG", "test", 1.4), ("DEBUG", "behavior", 1.1), ("HOW_X_WORKS", "behavior", 1.3), ("HOW_X_WORKS", "module", 1.2), ("HOW_X_WORKS", "interface", 1.1),
    ("SYMBOL_LOOKUP", "interface", 1.4), ("SYMBOL_LOOKUP", "behavior", 1.1), ("OVERVIEW", "module", 1.5), ("OVERVIEW", "interface", 1.2), ("FILE_LOOKUP", "module", 1.2),
]

# Conversations and answers
INTERESTING_LINE = r"(?i)(error|exception|traceback|failed|failing|assert|TODO|\.py|\.ts|\.tsx|\.js|\.json|line [0-9]+)"
EVIDENCE_PATH = r"(?i)(?:[A-Za-z]:[\\/]|[./])?(?:[A-Za-z0-9_.\-]+[\\/])+[A-Za-z0-9_.\-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|kt|cs|cpp|cc|c|h|hpp|rb|swift|scala|php|md|json|yaml|yml|toml|sql|graphql|proto|sh|bat|ps1)\b"
FENCE_ALIASES = {"py": "python", "python3": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "golang": "go", "rs": "rust", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "h": "c", "hpp": "cpp", "kt": "kotlin", "rb": "ruby", "cs": "csharp"}
EDIT_TAGS = ["<original_code>", "</original_code>", "<new_code>", "</new_code>", "<code_to_edit>", "</code_to_edit>", "<file_prefix>", "<file_suffix>", "<file_content>", "</file_content>", "<|editable_region_start|>", "<|editable_region_end|>", "<|fim_prefix|>", "<|fim_suffix|>", "<highlighted_code>", "</highlighted_code>", "<current_file>", "</current_file>", "<original>", "</original>", "<modified>", "</modified>"]
EDIT_PHRASES = [
    "rewrite the code_to_edit", "rewrite the code as specified", "output only the new file", "output only the updated file", "output the entire updated file", "apply the new code to", "apply the changes to the file", "do not wrap your response in triple-backticks",
    "merge the new code into", "you are given a code snippet", "make the following edit", "the user wants to edit", "output the edited code", "output only the edited", "here is the code to edit", "please make the following changes", "apply the following edit",
    "apply the following changes", "only output the code", "only return the code", "return the modified", "return the updated", "return only the", "the following is the code", "edit the code below", "you are an ai code editor", "your task is to apply",
    "apply the suggested changes", "output the complete modified", "output the complete updated", "output only the complete", "output the full modified", "output the full updated", "output the full file", "output just the file", "output just the code",
    "do not include any explanation", "do not include explanations", "without any explanation", "no explanation needed", "no explanations or comments", "here are the contents of the file", "the file currently contains", "apply the changes shown",
    "generate the modified version", "produce the complete file", "rewrite the file with", "you are a code editing assistant", "your job is to edit",
]
