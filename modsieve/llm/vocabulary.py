"""Word pieces of a byte-pair vocabulary with word ends: splitting, ids, and token counts of every prefix.

The vocabulary file's own library decides what a word is and which ids it has.  Text in common Latin
letters is split by an equivalent pattern, since that is several times faster; any other text is
normalised and split by the library, blank-separated chunk by chunk.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from modsieve.llm.workers import held

#: The white space of the vocabulary's own patterns.
BLANKS = "\t\n\v\f\r \u0085  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
BLANK = re.escape(BLANKS)
LETTER = "A-Za-zÀ-ÖØ-öø-ıĲ-ňŊ-ž"
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"

#: Texts of these characters only: each has one lower-case form of one character, and is its own composed form.
#: (The dotted capital I, whose lower-case form has two characters, and the letters that compose otherwise are left out.)
PLAIN = re.compile(f"[\t\n\r -~À-ÖØ-öø-įıĲ-ňŊ-ž]*")
PIECE = re.compile(f"[{BLANK}]*(?:{CONTRACTION}|[{LETTER}]+|[0-9]|[^{BLANK}0-9{LETTER}]+)")
CHUNK = re.compile(f"([{BLANK}]*)([^{BLANK}]+)")

#: Known prefixes are shared between words up to this many symbols; longer words go on in their own arrays.
SHARED = 24


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bounded(dict):
    """A memo filled by ``make`` in two generations of at most about ``limit`` entries each.

    ``trim`` starts a new generation; entries that are asked for again move on, the others go with the next one.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self._limit:
            self._old = dict(self)
            self.clear()


class Vocabulary:
    """One vocabulary file, opened once per worker by :func:`open_vocabulary`."""

    def __init__(self, path: str, memo: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-pair vocabulary with word ends")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: place for place, pair in enumerate(pairs)}
        self.size = max(self.library.get_vocab(True).values()) + 1
        self.halves = {a + b: (a, b) for a, b in pairs}
        #: 1: inside words, 2: at their end, 3: both
        self.kind: dict[str, int] = {}
        for token in model["vocab"]:
            last = token.endswith(self.end)
            text = token[: -len(self.end)] if last else token
            self.kind[text] = self.kind.get(text, 0) | (2 if last else 1)
        self.longest = max(map(len, self.kind))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.symbols = byte_symbols()
        self._fits: dict[tuple[str, str, bool], bool] = {}
        self._known: dict[str, tuple[int, str, int]] = {}
        self._memo = memo
        self.piece_ids = Bounded(self._ids_of, memo)
        self.piece_counts = Bounded(self._counts_of, memo)

    # ---- splitting ---------------------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn; odd places are special."""
        return self.special.split(text) if self.special and "<" in text else [text]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Words of an ordinary text, each with the blanks before it, and the number of blanks after the last.

        Composed and lower-cased, blanks as they are.  Joined, the pieces are the whole text.
        """
        if text.isascii() or PLAIN.fullmatch(text):
            lower = text.lower()
            found = PIECE.findall(lower)
            return found, len(lower) - sum(map(len, found))
        found, at = [], 0
        for match in CHUNK.finditer(text):
            at = match.end()
            gap, norm = match.group(1), self.library.normalizer.normalize_str(match.group(2))
            start = 0
            for _, (_, stop) in self.library.pre_tokenizer.pre_tokenize_str(norm):
                found.append(gap + norm[start:stop])
                gap, start = "", stop
        return found, len(text) - at

    def mapped(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])

    # ---- ids ---------------------------------------------------------------------------------

    def _ids_of(self, piece: str) -> bytes:
        word = piece.lstrip(BLANKS)
        return np.array([t.id for t in self.library.model.tokenize(self.mapped(word))], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers, nothing added."""
        out = []
        for place, segment in enumerate(self.segments(text)):
            if place % 2:
                out.append(np.array([self.library.token_to_id(segment)], "<u4").tobytes())
            elif segment:
                out += map(self.piece_ids.__getitem__, self.pieces(segment)[0])
        self.piece_ids.trim()
        return b"".join(out)

    # ---- token counts of every prefix --------------------------------------------------------

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging leaves the two tokens apart where they meet.

        Takes back the merges at the border, last one first.  If the pair then at the border would have
        merged before the merge taken back, the two tokens could not have come about side by side.
        Of equal ranks the leftmost merges first.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            rank, halves, limit, known = self.rank, self.halves, 1 << 60, True
            while True:
                if rank.get((left, right), limit) < limit:
                    known = False
                    break
                a, b = halves.get(left), halves.get(right)
                ra, rb = rank[a] if a else -1, rank[b] if b else -1
                if ra < 0 and rb < 0:
                    break
                if ra > rb:
                    left, limit = a[1], ra
                else:
                    right, limit = b[0], rb + 1
            self._fits[key] = known
        return known

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a mapped word, as a word of its own.

        Prefix dynamic programming.  The tokens of a prefix are the tokens of a shorter prefix and
        one last token that merging leaves apart from the token before it; exactly one last token
        qualifies.  So one stored last token and one count per prefix are enough.
        """
        size, known, kinds, longest, fit, end = len(word), self._known, self.kind, self.longest, self._fit, self.end
        count, last, out = [0] * (size + 1), [""] * (size + 1), [0] * size
        for j in range(1, size + 1):
            head = word[:j] if j <= SHARED else None
            state = known.get(head) if head is not None else None
            if state is None:
                missing = 3
                for i in range(j - 1, max(0, j - longest) - 1, -1):
                    token = word[i:j]
                    kind = kinds.get(token, 0) & missing
                    if kind & 1 and (i == 0 or fit(last[i], token)):
                        count[j], last[j] = count[i] + 1, token
                        missing &= 2
                    if kind & 2 and (i == 0 or fit(last[i], token + end)):
                        out[j - 1] = count[i] + 1
                        missing &= 1
                    if not missing:
                        break
                if head is not None:
                    known[head] = (count[j], last[j], out[j - 1])
            else:
                count[j], last[j], out[j - 1] = state
        return out

    def _counts_of(self, piece: str) -> bytes:
        word = piece.lstrip(BLANKS)
        gap = [0] * (len(piece) - len(word))
        if word[0] == "'" and len(word) > 2 and re.fullmatch(CONTRACTION, word):
            # a cut contraction is an apostrophe and a letter
            inner = [sum(self.prefix_counts(self.mapped(w))[-1] for w in PIECE.findall(word[:k])) for k in range(1, len(word))]
            counts = [*inner, self.prefix_counts(self.mapped(word))[-1]]
        elif word.isascii():
            counts = self.prefix_counts(self.mapped(word))
        else:
            every = self.prefix_counts(self.mapped(word))
            counts, at = [], -1
            for char in word:
                at += len(char.encode("utf-8", "surrogatepass"))
                counts.append(every[at])
        return np.array(gap + counts, np.int32).tobytes()

    def _ordinary(self, text: str) -> np.ndarray:
        found, rest = self.pieces(text)
        if not found:
            return np.zeros(rest, np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        inside = np.frombuffer(b"".join(map(self.piece_counts.__getitem__, found)), np.int32)
        totals = inside[np.cumsum(sizes) - 1]
        before = np.cumsum(totals, dtype=np.int32)
        counts = inside + np.repeat(before - totals, sizes)
        return np.append(counts, np.full(rest, before[-1], np.int32)) if rest else counts

    def counts(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text: entry ``i`` is the count of its first ``i + 1`` code points."""
        segments = self.segments(text)
        if len(segments) == 1:
            out = self._ordinary(text)
        else:
            # a special string is ordinary text until its last character is there
            parts, base = [], 0
            for k in range(0, len(segments), 2):
                segment, special = segments[k], segments[k + 1] if k + 1 < len(segments) else ""
                counts = self._ordinary(segment + special[:-1])
                whole = len(self._ids(segment)) if segment else 0
                parts.append(counts + base)
                base += whole + bool(special)
                if special:
                    parts.append(np.array([base], np.int32))
            out = np.concatenate(parts)
        self.piece_counts.trim()
        if len(self._known) > 2 * self._memo:
            self._known.clear()
        if len(self._fits) > 2 * self._memo:
            self._fits.clear()
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids(text), "<u4")


def open_vocabulary(path: str) -> Vocabulary:
    return held(("vocabulary", path), lambda: Vocabulary(path))
