"""Column functions over command lines and their output: classes, signals, shapes, predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, as text: what makes a line worth keeping, in logs and for declarative rules besides.
IMPORTANT_LOG = [
    "error", "fatal", "panic", "fail", "exception", "traceback", "warn", "critical", "severe", "denied", "forbidden", "unauthorized",
    "permission denied", "refused", "rejected", "timeout", "timed out", "unhealthy", "crashloop", "oom", "out of memory", "segfault", "abort",
]
IMPORTANT_RULE = [
    "cannot", "undefined", "unresolved", "invalid", "denied", "timeout", "timed out", "not found", "no such file", "crash", "segfault", "oom",
    "out of memory", "abort", "diagnostic", "violation", "problem", "issue", "destroy", "destroyed", "delete", "deleted", "deleting", "replacement",
    "replace", "tainted", "deposed", "drift", "crashloop", "unhealthy", "forbidden", "unauthorized", "permission denied", "connection refused",
]
#: Terminal escapes: control sequences, operating-system commands, strings, two-character ones, any other.
ESCAPES = r"\x1B\[[0-9;:<>?]*[ -/]*[@-~]|\x1B\][^\x07]*(?:\x07|\x1B\\)|\x1B[PX^_][^\x1B]*\x1B\\|\x1B[@-_]|\x1B."
#: Comments that stay.
KEPT_COMMENTS = r"\b(?:SAFETY:|INVARIANT:|TODO\(critical\):|FIXME\(critical\):|HACK\(critical\):)|\b(?:Copyright|SPDX-License-Identifier|All rights reserved|Licensed under)\b"
#: File extension (or name) by language.
LANGUAGES = {
    "go": [".go"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "rust": [".rs"], "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx"], "java": [".java"], "ruby": [".rb"], "shell": [".sh", ".bash", ".zsh"], "python": [".py"],
    "css": [".css", ".scss", ".sass"], "html": [".html", ".htm"], "yaml": [".yaml", ".yml"], "toml": [".toml"], "zig": [".zig"], "swift": [".swift"],
    "kotlin": [".kt", ".kts"], "php": [".php"], "dart": [".dart"], "lua": [".lua"], "scala": [".scala", ".sc"], "graphql": [".graphql", ".gql"],
    "protobuf": [".proto"], "hcl": [".tf", ".tfvars", ".hcl"], "powershell": [".ps1", ".psm1", ".psd1"], "perl": [".pl", ".pm"], "ocaml": [".ml", ".mli"],
    "haskell": [".hs", ".lhs"], "erlang": [".erl", ".hrl"], "elixir": [".ex", ".exs"], "solidity": [".sol"], "json5": [".json5"],
    "jsonnet": [".jsonnet", ".libsonnet"], "svelte": [".svelte"], "markdown": [".md", ".markdown", ".mdx"], "sql": [".sql"],
    "dockerfile": ["dockerfile", "containerfile"], "make": ["makefile", "gnumakefile"],
}
#: Commands whose output no later run replaces, and beginnings of those whose output one does.
UNREPEATABLE = ["tail -f", "follow", "watch ", "top ", "htop", "less ", "more ", "man ", "vi ", "vim ", "nano ", "ssh ", "telnet ", "nc ", "netcat "]
REPEATABLE = [
    "git status", "git diff", "git log", "git show", "git branch", "git remote", "git tag", "git stash list", "go test", "go build", "go vet", "go fmt", "go mod",
    "cargo test", "cargo build", "cargo check", "cargo clippy", "npm test", "npm run", "npx tsc", "npx eslint", "pytest", "python -m pytest", "make ", "cmake ",
    "rg ", "grep ", "find ", "ls ", "ls -", "ll ", "file ", "wc ", "cat ", "head ", "tail -", "docker ps", "docker images", "docker logs", "kubectl get",
    "kubectl describe", "kubectl logs", "helm list", "helm status", "systemctl status", "journalctl", "df ", "du ", "free ", "uname ", "ps ", "lsof ", "netstat ", "ss ",
]
#: Command lines that are refused.
DENIED = [
    r"(?i)(?:^|\s)rm\s+(-[rf]+\s+)*--?\s*no-preserve-root", r"(?i)(?:^|\s)rm\s+(-[rf]+\s+)*/\s*(?:\s|$)", r"(?i)(?:^|\s)mkfs\.",
    r"(?i)(?:^|\s)dd\s+if=/dev/(zero|random|urandom)", r"\(\)\s*\{\s*:\|:&\s*\};:",
]
#: What a success looks like, and what speaks against it.
BUILD_OK = r"(?i)(?:^|\n)\s*(?:BUILD SUCCESSFUL|Build succeeded|Compiling[^\n]*\n[^\n]*successfully|✓\s*Built in)"
TESTS_OK = r"(?i)(?:^|\n)\s*(?:All tests passed|Tests?:\s*\d+\s+passed(?:,\s*0\s+failed)?|OK\s*\(\d+\s+tests?\)|PASS\s*\z)"
LINT_OK = r"(?i)(?:^|\n)\s*(?:0 errors?|0 warnings?|No issues found|eslint:\s*no problems)"
NOT_OK = r"(?i)(?:^|\n)\s*(?:error|errors?|failed|FAIL|FAILED)\b[^\n]*[1-9]"
#: Words by signal.
KEYWORDS = {
    "error_keyword": ["abort", "aborted", "critical", "crash", "crashed", "denied", "error", "exception", "fail", "failed", "failure", "fatal", "invalid", "panic", "rejected", "timeout", "timed out"],
    "warning": ["warn", "warning"],
    "important": ["bug", "fix", "fixme", "hack", "important", "note", "todo", "xxx"],
    "security": ["auth", "password", "secret", "security"],
}
#: Bytes of an output that are classified: the rule's own bound.
ANALYZED = 65536


def _any(tokens: list[str]) -> str:
    return "|".join(re.escape(t) for t in tokens)


def _one_of(tokens: list[str]) -> str:
    """A pattern that finds one of the tokens, common beginnings only once: a character that begins none is passed at once."""
    short = [t for t in tokens if not any(o != t and o in t for o in tokens)]  # a token that holds another one tells nothing new

    def tree(some: list[str]) -> str:
        if "" in some:
            return ""
        heads = sorted({t[0] for t in some})
        return "|".join(re.escape(h) + (f"(?:{rest})" if "|" in (rest := tree([t[1:] for t in some if t[0] == h])) else rest) for h in heads)

    return "(?=[" + "".join(re.escape(h) for h in sorted({t[0] for t in short})) + f"])(?:{tree(sorted(set(short)))})"


def holds(text: Column, tokens: list[str]) -> Column:
    """The lower-cased text holds one of the tokens."""
    return F.lower(text).rlike(_one_of(tokens))


def important_log_line(line: Column) -> Column:
    return holds(line, IMPORTANT_LOG)


def important_rule_line(line: Column) -> Column:
    return holds(line, [*IMPORTANT_LOG, *IMPORTANT_RULE])


def strip_escapes(text: Column) -> Column:
    """All terminal escapes off, CRLF to LF, lone CR off."""
    return F.replace(F.replace(F.regexp_replace(text, ESCAPES, ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit(""))


def kept_comment(line: Column) -> Column:
    return line.rlike(KEPT_COMMENTS)


def safe_id(value: Column, blank: str = "anonymous") -> Column:
    """Trimmed, a fixed name if blank, and _ for what isn't a letter, digit, _ or -."""
    t = F.btrim(F.coalesce(value, F.lit("")), F.lit(" \t\n\r\x0b\f"))
    return F.when(t == "", F.lit(blank)).otherwise(F.regexp_replace(t, "[^A-Za-z0-9_-]", "_"))


def language_of_path(path: Column) -> Column:
    """The language of a file by its extension, or its name; empty if unknown."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    names = F.create_map(*[F.lit(x) for language, keys in LANGUAGES.items() for key in keys for x in (key, language)])
    by_ext = F.when(ext != "", F.try_element_at(names, ext))
    by_name = F.when(~F.startswith(base, F.lit(".")), F.try_element_at(names, base))
    return F.coalesce(by_ext, by_name, F.lit(""))


def repeatable(command: Column) -> Column:
    """A later run of the command makes an earlier output worthless."""
    c = F.lower(command)
    return ~c.rlike(_any(UNREPEATABLE)) & c.rlike(f"^(?:{_any(REPEATABLE)})")


def denied(command: Column, more: list[str] | None = None) -> Column:
    """Which rule refuses a command line: 'destructive', 'configured', or empty."""
    c = F.btrim(command)
    out = F.when(c == "", F.lit(""))
    for pattern in DENIED:
        out = out.when(c.rlike(pattern), F.lit("destructive"))
    for pattern in more or []:
        out = out.when(c.rlike(pattern), F.lit("configured"))
    return out.otherwise(F.lit(""))


def success_line(text: Column) -> Column:
    """The one line that stands for an output of at least 80 bytes that only tells success; null if it tells more."""
    lower = F.lower(text)
    plain = (F.octet_length(text) >= 80) & ~text.rlike(NOT_OK) & ~F.contains(lower, F.lit(" error:"))
    return (
        F.when(~plain, F.lit(None).cast("string"))
        .when(text.rlike(BUILD_OK) & ~F.contains(lower, F.lit("error")), F.lit("[ok] Build succeeded (output omitted)"))
        .when(text.rlike(TESTS_OK), F.lit("[ok] All tests passed (output omitted)"))
        .when(text.rlike(LINT_OK), F.lit("[ok] Lint clean (output omitted)"))
    )


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\r\x0b\f"))


def _is_json(text: Column) -> Column:
    """Valid JSON and nothing behind it: it stands as the one element of an array and of an object."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def log_shape(text: Column) -> Column:
    """struct<shape, confidence> by the shares of the first 50 lines that aren't blank; the most certain shape, the first of equal ones."""
    rows = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 50), _trim), lambda x: x != "")
    n = F.size(rows)
    share = lambda test: F.size(F.filter(rows, test)) / n
    shapes = [
        ("iso8601", share(lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), 0.6),
        ("unix", share(lambda x: x.rlike(r"^\d{9,10}\.")), 0.6),
        ("syslog", share(lambda x: x.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}")), 0.6),
        ("bracketed", share(lambda x: x.rlike(r"^\[[A-Z]+\]")), 0.5),
        ("jsonlines", share(lambda x: F.startswith(x, F.lit("{")) & (F.length(x) >= 2) & _is_json(x)), 0.5),
    ]
    found = F.array(*[F.when(c >= least, c).otherwise(0.0) for _, c, least in shapes])
    best = F.array_max(found)
    severe = share(lambda x: x.rlike("INFO|WARN|ERROR|DEBUG|TRACE|FATAL"))
    pick = lambda name, c: F.struct(F.lit(name).alias("shape"), c.cast("double").alias("confidence"))
    out = F.when(F.coalesce(n, F.lit(0)) <= 0, pick("none", F.lit(0.0)))
    for i, (name, _, _) in enumerate(shapes):
        out = out.when((best > 0) & (found[i] == best), pick(name, best))
    return out.when(severe >= 0.3, pick("bracketed", severe)).otherwise(pick("none", F.lit(0.0)))


def _analyzed(text: Column, bound: int | None = ANALYZED) -> tuple[Column, Column]:
    """The part that is classified, and whether something was cut off; without a bound nothing is."""
    if bound is None:
        return F.coalesce(text, F.lit("")), F.lit(False)
    long = F.octet_length(text) > bound
    part = F.when(long, F.substring(text.cast("binary"), 1, bound).cast("string")).otherwise(text)
    return F.coalesce(part, F.lit("")), F.coalesce(long, F.lit(False))


def _path_start(line: Column) -> Column:
    """What stands before a line's first separator (a colon or dash before a digit, else the first colon) looks like a path."""
    numbered = F.regexp_extract(line, r"(?s)^(.*?)[:-][0-9]", 1)
    head = F.when(line.rlike(r"[:-][0-9]"), numbered).otherwise(F.substring_index(line, ":", 1))
    return F.when(line.rlike(r"^[A-Za-z]:[\\/]"), F.lit(True)).otherwise(head.rlike(r"[/\\.]"))
