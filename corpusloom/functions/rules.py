"""Fixed rules about files: what is ignored, what is binary, which language a name means."""

# ---- fixed values, in the order in which they hold
IGNORED = (
    ".git .github/cache node_modules dist build target coverage htmlcov .next .nuxt .cache venv .venv __pycache__ .idea .vscode logs *.log *.pyc *.lock *lock.json *lock.yaml .pytest_cache .mypy_cache"
).split()
BINARY_SUFFIXES = ".png .jpg .jpeg .gif .webp .bmp .ico .svg .pdf .mp4 .mov .avi .mp3 .wav .zip .rar .7z .tar .gz .exe .dll .so .o .a .class .jar .pyc".split()
MOST_BYTES = 50 * 1024 * 1024
SNIFFED_BYTES = 8192
MOST_CONTROL = 0.30
SUFFIX_LANGUAGES = {
    s: language
    for language, suffixes in {
        "python": ".py .pyw", "rust": ".rs", "go": ".go", "javascript": ".js .jsx", "typescript": ".ts .tsx", "c": ".c .h", "cpp": ".cpp .hpp .cc .cxx", "java": ".java", "kotlin": ".kt .kts", "swift": ".swift",
        "bash": ".sh .bash .zsh", "ruby": ".rb", "php": ".php", "csharp": ".cs", "perl": ".pl .pm", "r": ".r", "scala": ".scala", "ocaml": ".ml .mli", "haskell": ".hs", "erlang": ".erl .hrl", "elixir": ".ex .exs",
        "solidity": ".sol", "terraform": ".tf .tfvars", "protobuf": ".proto", "graphql": ".graphql .gql", "prisma": ".prisma", "sql": ".sql", "html": ".html .htm", "css": ".css", "sass": ".scss .sass", "json": ".json",
        "yaml": ".yaml .yml", "xml": ".xml", "markdown": ".md", "toml": ".toml", "ini": ".ini .cfg .conf", "text": ".txt", "dockerfile": ".dockerfile", "makefile": ".makefile",
    }.items()
    for s in suffixes.split()
}
NAME_LANGUAGES = {
    "dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile", "jenkinsfile": "groovy", "vagrantfile": "groovy", "cmakelists.txt": "cmake", "cargo.toml": "toml", "package.json": "json", "go.mod": "go",
    "license": "text", "copying": "text", "readme": "text",
}
SHEBANG_LANGUAGES = (("python", "python"), ("sh", "bash"), ("node", "javascript"), ("ruby", "ruby"), ("perl", "perl"))
CANDIDATE_TYPES = "function method class interface enum struct trait type_alias chunk documentation_chunk".split()
STOP_WORDS = (
    "a an and any array as async at await bool by calculated class const def defined dependencies dict else enum export false float fn for from function if impl import in inputs int interface is let list map mut none null number object of on or pub purpose "
    "represents responsible return returns self set str string struct the this to trait true tuple type undefined use var void while with"
).split()
TOP_UP = "code symbol ast retrieval enrichment".split()


def glob_regex(pattern: str) -> str:
    """A file glob as a regular expression over the whole name; `*` also crosses folders."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c) or (c if c.isalnum() or c in "_/-" else "\\" + c) for c in pattern) + "$"
