"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_secrets(text):
    """(n_assign, n_access, n_hex, digest) of the pattern spans."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    counts = Counter(k for _, k, _ in spans)
    names = ("assign", "access", "hex")
    return counts[0], counts[1], counts[2], sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans)))


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def lines_left(docs, max_docs):
    """Share of the characters of distinct lines within the limit; docs: (id, text, host)."""
    normal = [
        (i, h, list(dict.fromkeys(x.strip(" ").lower() for x in (t or "").split("\n") if WORD.search(x))))
        for i, t, h in docs
    ]
    owners = {}
    for i, h, lines in normal:
        for line in lines:
            owners.setdefault((h, line), set()).add(i)
    out = []
    for _, h, lines in normal:
        whole = sum(map(len, lines))
        left = sum(len(x) for x in lines if len(owners[h, x] - {None}) <= max_docs)
        out.append(left / whole if whole else None)
    return out
