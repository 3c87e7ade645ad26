"""Byte-pair merging over a vocabulary file: a heap of adjacent pairs and a linked list of symbols."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex

# ---- fixed values: letters of the quick alphabet, contractions that stand alone
QUICK_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# ---- end of fixed values

WHITE = "\\t-\\r "
#: any character outside printable ASCII, plain white space and Latin letters
ODD = re.compile(f"[^{WHITE}!-~À-ÖØ-öø-ɏ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Merge ranks, ids and special strings of a ``tokenizers`` JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        pairs = [p.split(" ", 1) if isinstance(p, str) else p for p in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.byte = byte_symbols()

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """Cut at special strings: (is special, part), empty parts left out."""
        if not self.special_split:
            return [(False, text)] if text else []
        return [(k % 2 == 1, p) for k, p in enumerate(self.special_split.split(text)) if p]

    def symbols(self, word: str) -> list[str]:
        out = [self.byte[b] for b in word.encode()]
        if out and self.suffix:
            out[-1] += self.suffix
        return out

    def merged(self, symbols: list[str]) -> tuple[list[str | None], int]:
        """Merge in place; the number of merges comes with the symbols (merged-away places hold None)."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get((symbols[i], symbols[i + 1]))
            if r is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get((symbols[i], symbols[k]))
                if r is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get((symbols[h], symbols[i]))
                if r is not None:
                    heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return symbols, merges

    def count(self, word: str) -> int:
        """Initial symbols minus merges; no identifier is looked up."""
        symbols = self.symbols(word)
        return len(symbols) - self.merged(symbols)[1]

    def encode(self, word: str) -> list[int]:
        return [self.ids[s] for s in self.merged(self.symbols(word))[0] if s is not None]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word or special string as little-endian unsigned 32-bit numbers."""
        ids = [self.special[word]] if word in self.special else self.encode(word)
        return b"".join(i.to_bytes(4, "little") for i in ids)


class SpacedSplitter:
    """Words with their leading space, as byte-level vocabularies split them; nothing is lost."""

    def __init__(self):
        quick = QUICK_LETTERS
        self.quick = re.compile(
            f"{CONTRACTIONS}| ?[{quick}]+| ?[0-9]+| ?[^{WHITE}{quick}0-9]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
        )
        self.full = regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")

    def __call__(self, text: str) -> list[str]:
        return (self.full if ODD.search(text) else self.quick).findall(text)


class LowerSplitter:
    """Composed, lower-cased words without white space; digits stand alone."""

    def __init__(self):
        quick = QUICK_LETTERS.replace("A-Z", "")
        self.quick = re.compile(f"{CONTRACTIONS}|[{quick}]+|[0-9]|[^{WHITE}{quick}0-9]+")
        self.full = regex.compile(rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")

    def __call__(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # capital sigma is lowered without regard to its place in the word
        text = text.replace("Σ", "σ").lower()
        return (self.full if ODD.search(text) else self.quick).findall(text)
