"""Extensions, languages and excluded directories.  Fixed values."""

LANGUAGE_BY_EXTENSION = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "py": "python",
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "cs": "csharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "swift": "swift", "dart": "dart", "scala": "scala", "groovy": "groovy",
    "vue": "typescript", "svelte": "typescript", "ex": "elixir", "exs": "elixir",
}
SOURCE_EXTENSIONS = (
    "java", "kt", "kts", "py", "ts", "tsx", "js", "jsx", "cs", "go", "rs", "rb", "php",
    "swift", "dart", "scala", "groovy", "clj", "ex", "exs", "vue", "svelte",
)
EXCLUDED_DIRS = (
    "node_modules", ".git", ".idea", ".gradle", "build", "dist", "out",
    "__pycache__", ".venv", "venv", "target", ".next", ".nuxt",
    "vendor", "Pods", ".dart_tool", ".pub-cache", ".svn", ".hg",
    "bin", "obj", ".vs", ".settings", ".classpath", ".project",
)
