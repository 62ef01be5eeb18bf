"""Patterns and word lists, and the columns that apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six leak patterns. Word bounds are written out, so that they hold for
# letters of any script and do not depend on an engine's flags.
_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
LEAK_PATTERNS = {
    "windows_drive_path": r"[A-Za-z]:\\|[A-Za-z]:/",
    "evidence_ext_or_format": rf"(?i)\.e01{_EDGE_R}|{_EDGE_L}E01{_EDGE_R}|{_EDGE_L}RAW{_EDGE_R}|{_EDGE_L}VMDK{_EDGE_R}",
    "bitlocker": r"(?i)bitlocker",
    "raw_users_path": rf"(?i){_EDGE_L}Users\\[A-Za-z0-9_. -]+",
    "credential_word": r"(?i)password|credential|secret",
    "home_path": r"/home/[A-Za-z0-9_.-]+",
}

#: Texts of which every match of a leak pattern holds one, in lower case: a cheap test that comes
#: before the pattern.
LEAK_HINTS = {
    "windows_drive_path": (":\\", ":/"),
    "evidence_ext_or_format": ("e01", "raw", "vmdk"),
    "bitlocker": ("bitlocker",),
    "raw_users_path": ("users\\",),
    "credential_word": ("password", "credential", "secret"),
    "home_path": ("/home/",),
}

# Owners that are placeholders, and the four home-path patterns.
PLACEHOLDER_OWNERS = ("name", "user", "USER", "ANALYST")
HOME_PATTERNS = {
    "Linux home path": r"/home/(?!(?:name|user|USER|ANALYST)/)([A-Za-z0-9._-]+)/",
    "macOS home path": r"/Users/(?!(?:name|user|USER|ANALYST)/)([A-Za-z0-9._-]+)/",
    "WSL-mounted Windows user path": r"(?i)/mnt/[a-z]/Users/(?!(?:name|user|USER|ANALYST)/)([A-Za-z0-9._-]+)/",
    "Windows user path": r"[A-Za-z]:\\Users\\(?!(?:name|user|USER|ANALYST)\\)([A-Za-z0-9._-]+)\\",
}

# Command text that is unsafe to run or log.
UNSAFE_TOKENS = ("Where-Object {", "ForEach-Object {", "+.", ".IncludeUserName", "$", "Now.AddHours", "&&")

# Files that should not be published, by exact path and by glob at the root.
FORBIDDEN_PATHS = {
    ".tmp_test_probe.py": "scratch probe files should not be committed",
    ".vscode/tasks.json": "workstation-specific VS Code tasks should stay local",
}
FORBIDDEN_GLOBS = {".tmp_*": "scratch files should not be committed"}

# Folders that a file inventory leaves out, by name and by path from the root.
IGNORED_NAMES = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "venv")
IGNORED_PATHS = ("acquisitions", "artifacts", "cases", "evidence", "exports", "reports", "toolcache", "tooling/cache", "tooling/downloads")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9])(?<![0-9]\.){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?![0-9]|\.[0-9])"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_LABEL_L, _LABEL_R = r"(?<![A-Za-z0-9-])(?<![A-Za-z0-9-]\.)", r"(?![A-Za-z0-9-]|\.[A-Za-z0-9-])"
# a name may hold full stops, but one that follows it ends the sentence
_PLAIN_OWNER = r"(?!(?:name|user|USER|ANALYST)(?!\.*[A-Za-z0-9_-]))\.*[A-Za-z0-9_-]++(?:\.++[A-Za-z0-9_-]++)*+"

#: What redaction replaces, in this order: class, texts of which every match holds one (lower
#: case, if letter case is no matter), is it none, pattern, placeholder. Guards on the left keep a
#: run from being tried at each of its letters.
REDACTIONS = (
    ("email", ("@",), False, _EMAIL, "<EMAIL>"),
    ("token", ("token", "password", "secret", "api_key", "akia"), True, r"(?i:token|password|secret|api_key) ?[=:] ?\"?[A-Za-z0-9_-]{8,}\"?|AKIA[0-9A-Z]{16}[0-9A-Za-z]*+", "<TOKEN>"),
    ("ip", (".",), False, _IP, "<IP>"),
    ("workspace_path", ("/workspace/", "/mnt/", "/evidence/", "/analysis/"), False, r"/(?!(?:evidence/image\.E01|analysis/report\.md)(?![A-Za-z0-9._/-]))(?:workspace|mnt/[a-z]|evidence|analysis)/[A-Za-z0-9._/-]+", "<WORKSPACE_PATH>"),
    ("user", ("/home/", "/Users/", ":\\Users\\"), False, rf"/home/{_PLAIN_OWNER}|/Users/{_PLAIN_OWNER}|[A-Za-z]:\\Users\\{_PLAIN_OWNER}", "<USER>"),
    ("host", (".internal", ".local", ".corp", ".lan"), False, rf"{_LABEL_L}(?:[A-Za-z0-9-]++\.)+?(?:internal|local|corp|lan){_LABEL_R}", "<HOST>"),
)
PLACEHOLDER_HINTS = ("<", "CASE-", "HOST-", "USER-", "ORG-NAME", "/evidence/image.E01", "/analysis/report.md")
PLACEHOLDERS = r"<(?:EMAIL|USER|HOST|TOKEN|IP|WORKSPACE_PATH)>|CASE-[0-9]{3}|HOST-[A-Z]|USER-[A-Z]|ORG-NAME|/evidence/image\.E01|/analysis/report\.md"

#: Features that a histogram counts. A domain stands by itself or after a scheme, not in an address.
FEATURES = {
    "email": _EMAIL,
    "url": r"https?://[A-Za-z0-9./?=_%&:~#-]+",
    "domain": rf"(?<![@._%+]){_LABEL_L}(?:[A-Za-z0-9-]++\.)+?(?:com|org|net|edu|gov|io|info|dev|example|test)(?!@){_LABEL_R}",
    "ip": _IP,
    "phone": r"\+[0-9]{1,3} ?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}",
}

#: Texts of which every match of a feature holds one.
FEATURE_HINTS = {
    "email": ("@",),
    "url": ("://",),
    "domain": (".com", ".org", ".net", ".edu", ".gov", ".io", ".info", ".dev", ".example", ".test"),
    "ip": (".",),
    "phone": ("+",),
}

#: Secret leads: type, service guessed, pattern with the value in group 1. As in REDACTIONS, the
#: letter case of key words is no matter.
SECRETS = (
    ("api_token", "generic", r"(?i:token) = \"([0-9a-f]{40})\""),
    ("password", "generic", r"(?i:password)=([A-Za-z0-9]{8,})"),
    ("access_key", "cloud", r"(AKIA[0-9A-Z]{16}[0-9A-Za-z]*)"),
)

#: Further leads, for which no SQL is given: the key words and lengths of REDACTIONS where no
#: pattern of SECRETS finds the same value, and private keys, to their end where they have one.
_VALUE = r" ?[=:] ?\"?([A-Za-z0-9_-]{8,})"
MORE_SECRETS = (
    ("api_token", "generic", r"(?i:token)(?! = \"[0-9a-f]{40}\")" + _VALUE),
    ("password", "generic", r"(?i:password)(?!=[A-Za-z0-9]{8})" + _VALUE),
    ("secret", "generic", "(?i:secret)" + _VALUE),
    ("api_key", "generic", "(?i:api_key)" + _VALUE),
    ("private_key", "generic", r"(-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END)?)"),
)

# The sections of a review note.
SECTIONS = (
    "report reviewed", "supported findings", "challenged findings", "missing corroboration",
    "alternative explanations", "required wording changes", "release recommendation",
)


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def flags(text: Column) -> dict[str, Column]:
    """The six leak flags of a text; null text leaks nothing."""
    low = F.lower(text)
    return {name: F.coalesce(holds_any(low, LEAK_HINTS[name]) & text.rlike(p), F.lit(False)) for name, p in LEAK_PATTERNS.items()}


def any_of(columns: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in columns.values():
        out = out | c
    return out


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("long")


def digest_prefix(text: Column) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, 16))


def glob_regex(glob: str) -> str:
    """A pattern for a whole string in which * stands for any text and ? for one character."""
    import re

    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


#: What counts as white space at the ends of a line or note.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")
