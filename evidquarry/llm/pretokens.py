"""Splitting text into pre-tokens as the tokenizer files ask for, and reading those files.

Letters, numbers and white space are Unicode's up to version 16.0. The pattern engine
already knows later letters, which the tokenizers treat as other symbols, so texts with
such letters take a pattern that leaves them out.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

# Letters and numbers assigned after Unicode 16.0 (first and last code point).
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
LATER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))


def _class(ranges) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


LATER = regex.compile(f"[{_class(LATER_LETTERS + LATER_NUMBERS)}]")
_MAYBE_LATER = re.compile(f"[{chr(LATER_LETTERS[0][0])}-{chr(0x10FFFF)}]")  # one range: quick to rule out
#: The two splitting rules of the files; L, N and O stand for letter, number and other.
BYTE_RULE = "'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+"
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|L+|N|O+"


class Splitter:
    """Pre-tokens of a text by one of the two rules."""

    def __init__(self, rule: str):
        later_l, later_n = _class(LATER_LETTERS), _class(LATER_NUMBERS)
        plain = {"L": r"\p{L}", "N": r"\p{N}", "O": r"[^\s\p{L}\p{N}]"}
        narrow = {
            "L": rf"[\p{{L}}--[{later_l}]]", "N": rf"[\p{{N}}--[{later_n}]]",
            "O": rf"[[^\s\p{{L}}\p{{N}}]||[{later_l}{later_n}]]",
        }
        build = lambda names: "".join(names.get(c, c) for c in rule)
        self.plain = regex.compile(build(plain)).findall
        self.narrow = regex.compile(build(narrow), regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        later = not text.isascii() and _MAYBE_LATER.search(text) and LATER.search(text)
        return self.narrow(text) if later else self.plain(text)


# Lower-case forms newer than the Unicode version of the Python library.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEWER = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")
_MAYBE_NEWER = re.compile(f"[{chr(min(_LOWER))}-{chr(0x10FFFF)}]")


def lowered(text: str) -> str:
    """Composed, and each character lower-cased on its own.

    The files also turn white space runs into one blank, which makes no difference to the
    pre-tokens: white space only separates them.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _MAYBE_NEWER.search(text) and _NEWER.search(text):
            text = text.translate(_LOWER)
        if "Σ" in text:  # its form at a word's end depends on the neighbours otherwise
            text = text.replace("Σ", "σ")
    return text.lower()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the files, back to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file, in bytes.

    A token that must end a word is keyed by its bytes followed by ``None`` as a pair
    (bytes, True); other tokens by (bytes, False).
    """

    def __init__(self, content: str):
        data = json.loads(content)
        model, back = data["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}

        def key(token: str) -> tuple[bytes, bool]:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            return bytes(back[c] for c in (token[: -len(self.suffix)] if ends else token)), ends

        self.ids: dict[tuple[bytes, bool], int] = {}
        named: dict[str, int] = {}
        for token, number in model["vocab"].items():
            if token not in self.special:
                named[token] = number
                self.ids[key(token)] = number
        self.bytes_of = {number: k[0] for k, number in self.ids.items()}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((named[left], named[right]), (rank, named[left + right]))
        #: ids of single bytes inside a word and at its end
        self.inner = [self.ids.get((bytes([b]), False)) for b in range(256)]
        self.final = [self.ids.get((bytes([b]), True)) for b in range(256)] if self.suffix else self.inner
        # the longest special string is tried first at every place, as the files' library does
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        return self._cut.split(text) if self._cut and any(s in text for s in self.special) else [text]

    def merged(self, word: bytes) -> list[int]:
        """Token ids of one pre-token by applying the merges, lowest rank and leftmost first.

        A heap holds the merges at hand, so a word of n bytes takes n log n steps.
        """
        from heapq import heapify, heappop, heappush

        if not word:
            return []
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        count = len(ids)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(count - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, whole, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= count or ids[j] != right:
                continue
            ids[i], ids[j] = whole, None
            after[i] = after[j]
            if after[i] < count:
                before[after[i]] = i
            for k in (before[i], i):
                n = after[k] if k >= 0 else count
                if n < count and (m := self.merges.get((ids[k], ids[n]))):
                    heappush(heap, (m[0], k, m[1], ids[k], ids[n]))
        return [t for t in ids if t is not None]
