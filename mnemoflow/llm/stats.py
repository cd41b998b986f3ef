"""Document statistics for the quality operators, from the UTF-8 bytes of a whole text."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

#: Names of what ``features`` returns, in its order.
FEATURES = (
    "log_words", "word_length", "symbol_share", "symbol_words", "upper_share", "digit_share", "punct_share",
    "exclaim_share", "other_byte_share", "dup_line_share", "repeat_share", "repeat_words_share", "same_next_share", "distinct_share",
    "hapax_share", "top_word_share", "entropy", "line_words", "line_end_share", "short_line_share", "pipe_share", "longest_word",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_punct = list(b".,;:!?")
_upper, _digits = slice(65, 91), slice(48, 58)


def repeat_mask(ids: np.ndarray, k: int = 3) -> np.ndarray:
    """Which words stand in a window of k words that occurs twice or more; ids number the words of one text."""
    n = len(ids)
    mask = np.zeros(n, bool)
    if n <= k:
        return mask
    key = ids[: n - k + 1].astype(np.int64)
    for j in range(1, k):
        top = int(ids.max()) + 1
        if key.max(initial=0) > (1 << 62) // top:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * top + ids[j : n - k + 1 + j]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    for j in range(k):
        mask[at + j] = True
    return mask


def describe(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text; zeros for an empty one."""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    spaces = int(hist[9:14].sum() + hist[32])
    points = len(text) - int(hist[128:192].sum())
    symbols = int(hist[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    mask = repeat_mask(ids)
    repeats = int(mask.sum())
    counts = [n, points - spaces, symbols, dup_lines, repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    tf = np.bincount(ids)
    chars = max(points - spaces, 1)
    p = hist[hist > 0] / len(text)
    ends = sum(x.rstrip(SPACES)[-1:] in (b".", b"!", b"?") for x in lines)
    feats = [
        float(np.log1p(n)), chars / n, symbols / chars, sum(w.endswith((b"*", b"$", b"%", b"&", b"#", b"|")) for w in words) / n,
        int(hist[_upper].sum()) / chars, int(hist[_digits].sum()) / chars, int(hist[_punct].sum()) / chars, int(hist[33]) / n,
        int(hist[194:].sum()) / chars, dup_lines / len(lines), repeats / n, int(repeat_mask(ids, 2).sum()) / n,
        float(np.count_nonzero(ids[1:] == ids[:-1])) / n, len(tf) / n, float(np.count_nonzero(tf == 1)) / n, float(tf.max()) / n,
        float(-(p * np.log2(p)).sum()), n / len(lines), ends / len(lines), sum(len(x) < 20 for x in lines) / len(lines), int(hist[124]) / n,
        float(np.log1p(max(map(len, words)))),
    ]
    return counts, feats


def describe_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [describe(t) for t in texts]
    counts = np.array([c for c, _ in both], np.int64).reshape(len(texts), len(COUNTS))
    feats = np.array([f for _, f in both], float).reshape(len(texts), len(FEATURES))
    return counts, feats
