"""Plain Python versions of the contracts, to hold the operators against."""

import hashlib
import re

BASE = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def secrets(text):
    text = text or ""
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, pat, least, group) in enumerate(BASE) for m in pat.finditer(text) if len(m.group(group)) >= least]
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    counts = [sum(x[1] == r for x in found) for r in range(3)]
    return (*counts, hashlib.sha256(line.encode()).hexdigest(), line)


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams, hit = {}, set()
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)
