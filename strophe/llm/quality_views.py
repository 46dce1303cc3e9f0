"""The two views of a document that the co-training classifier learns from, as sparse vectors."""

from __future__ import annotations

import re

import numpy as np

BITS = 18
DIMS = 1 << BITS
META_DIMS = 1 << 12
SEEN_WORDS = 150_000
SYMBOLS = re.compile(r"[#*$%&|<>{}\\=+~^@_]")
LETTERS = re.compile(r"[^\W\d_]+")


def binned(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


class TextView:
    """Words of the text (each once) and bins of its shape; whole texts."""

    def __init__(self):
        import xxhash

        self.digest, self.slots = xxhash.xxh3_64_intdigest, {}

    def slot(self, name: str) -> int:
        at = self.slots.get(name)
        if at is None:
            if len(self.slots) > SEEN_WORDS:
                self.slots.clear()
            at = self.slots[name] = self.digest(name.encode("utf-8", "replace")) & (DIMS - 1)
        return at

    def __call__(self, text: str) -> np.ndarray:
        lowered = text.lower()
        words, tokens, lines = set(LETTERS.findall(lowered)), text.split(), [x for x in text.split("\n") if x.strip()]
        n = max(len(tokens), 1)
        runs = list(zip(*(tokens[k:] for k in range(5)), strict=False))
        shape = (
            ("len", binned(len(tokens), (10, 30, 100, 300, 1000, 5000))), ("mean", binned(len(text) / n, (3, 4, 5, 6, 7, 8, 10))),
            ("sym", binned(len(SYMBOLS.findall(text)) / n, (0.01, 0.05, 0.2, 0.5))), ("up", binned(sum(map(str.isupper, tokens)) / n, (0.02, 0.1, 0.5))),
            ("dig", binned(sum(map(str.isdigit, text)) / max(len(text), 1), (0.01, 0.05, 0.2))),
            ("excl", binned((text.count("!") + text.count("?")) / n, (0.05, 0.2, 0.5))),
            ("same", binned(1 - len(set(lines)) / max(len(lines), 1), (0.1, 0.3, 0.5))), ("rep", binned(1 - len(set(runs)) / max(len(runs), 1), (0.05, 0.1, 0.2, 0.5))),
            ("uni", binned(len(words) / n, (0.1, 0.3, 0.5, 0.7))), ("stop", binned(n and len(words & FREQUENT), (0, 2, 5, 9))),
        )
        slots = {self.slot(w) for w in words} | {self.slot(f"\t{k}{b}") for k, b in shape}
        return np.array(sorted(slots), dtype=np.int32)


#: Frequent function words (fixed values); how many a text has is a shape feature.
FREQUENT = frozenset(("the", "of", "and", "to", "in", "is", "was", "that", "der", "die", "und", "das", "den", "von", "zu", "de", "la", "le", "les",
                      "et", "que", "des", "en", "du", "el", "los", "las", "con", "su", "por"))


class MetaView:
    """Source, language, length and their combinations: what is known of a page without its text."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest

    def __call__(self, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
        size = -1 if n_chars is None else binned(n_chars, (50, 100, 200, 400, 800, 1200, 1800, 2600, 4000, 8000, 16000, 40000))
        names = (f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}", f"l{lang}n{size}", "bias")
        return np.array(sorted({self.digest(x.encode()) & (META_DIMS - 1) for x in names}), dtype=np.int32)
