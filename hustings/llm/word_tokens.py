"""Exact tokenization by the tokenizers library, a word at a time.

The word-level vocabulary file drops white space and splits at it after composing (NFC) and lower-casing; neither step looks
across a space, tab or line break, and no special token holds one. So the ids of a text are those of its pieces between
them, one after another, and each distinct piece needs encoding once per worker. The memory for pieces is bounded.

All this holds for files with the settings below alone; with a file of other settings texts are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
from functools import lru_cache

import numpy as np

#: Pieces remembered by a worker, the longest piece that is remembered, and the longest that stays when there are too many.
REMEMBERED, LONGEST, SHORT = 1_000_000, 48, 8
#: The settings of a file whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: The first character beyond Latin-1.
LATIN = "\u0100"


def plain(piece: str) -> tuple[str, str]:
    """(stem, mark): two pieces with the same ids, end to end. A stop or comma after letters or digits is a token of its own."""
    return (piece[:-1], piece[-1]) if piece[-1] in ".," and piece[:-1].isalnum() and max(piece) < LATIN else (piece, "")


def lowered(text: str) -> str:
    """In lower case, where that changes no ids: Latin-1 without the start of a special token, composed as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def splits_at_space(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those that word-wise encoding relies on."""
    first = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    split = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", SPLITTER, "Removed", True)
    special = all(a["content"][:2] == "<|" and not any(c.isspace() for c in a["content"]) and not (a["lstrip"] or a["rstrip"]) for a in settings["added_tokens"])
    model = settings["model"]
    sure = not model.get("dropout") and not model.get("ignore_merges") and settings["truncation"] is None and settings["padding"] is None
    return settings["normalizer"] == NORMALIZER and split and special and sure and model["type"] == "BPE"


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.by_word = splits_at_space(json.loads(self.tokenizer.to_str()))

    def _learn(self, missing: set[str]) -> None:
        known = self.known
        made = {piece: plain(piece) for piece in missing}
        new = [x for x in {x for two in made.values() for x in two} if x not in known]
        words = [x for x in new if x.isalpha() and max(x) < LATIN]
        for at in range(0, len(words), 1000):  # words of letters alone are encoded together: the library numbers them
            part = words[at : at + 1000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            packed, width = np.array(got.ids, self.dtype).tobytes(), self.dtype.itemsize
            start = 0
            for piece, end in zip(part, (np.searchsorted(got.word_ids, np.arange(len(part)), "right") * width).tolist(), strict=True):
                known[piece] = packed[start:end]
                start = end
        rest = [x for x in new if x not in known]
        for piece, got in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            known[piece] = np.array(got.ids, self.dtype).tobytes()
        for piece, (stem, mark) in made.items():
            known[piece] = known[stem] + known[mark] if mark else known[stem]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed as self.dtype; null counts as empty."""
        if not self.by_word:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        collects = gc.isenabled()
        gc.disable()  # many short-lived tuples, no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:  # short pieces are the ones that come again
            keep = {k: v for k, v in self.known.items() if len(k) <= SHORT}
            self.known = keep if len(keep) < REMEMBERED * 3 // 4 else {"": b""}
        split, found, gaps, missing = [], [], [], set()
        for t in texts:
            words = lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else []
            ids = list(map(self.known.get, words))
            own, at = [], -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    own.append(at)
            except ValueError:
                pass
            missing.update(words[at] for at in own)
            split.append(words)
            found.append(ids)
            gaps.append(own)
        self._learn(missing)
        for words, ids, own in zip(split, found, gaps, strict=True):
            for at in own:
                ids[at] = self.known[words[at]]
        for piece in missing:
            if len(piece) > LONGEST:
                self.known.pop(piece, None)
                self.known.pop(plain(piece)[0], None)
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    return WordEncoder(path)
