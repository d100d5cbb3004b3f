"""Token ids of whole texts by a ``tokenizers`` file whose model drops white space, one word at a time."""

from __future__ import annotations

import re

import numpy as np

from barflow.llm.common import SPACE, remembered

REMEMBERED = 700_000
LONGEST_REMEMBERED = 64
WORDS_A_CALL = 1024  # the library keeps an object for each token of a call
_GAP = re.compile(f"[^{re.escape(SPACE)}]+")


class WordCoder:
    """Ids of a text are those of its words in order, because normalisation and splitting never look across white space."""

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # A special token that parts the words of one long text, so that many words are one call.
        special = [t for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.mark = min((t.content for t in special), default=None)
        self.mark_id = self.library.token_to_id(self.mark) if self.mark else None
        joined, apart = (self.library.encode(x, add_special_tokens=False).ids for x in ("One  wörd's\n9x", "One"))
        if joined != apart + sum((self.library.encode(x, add_special_tokens=False).ids for x in ("wörd's", "9x")), []):
            raise ValueError("this tokenizer does not code words one by one")

    def code_new(self, words: list[str]) -> list[bytes]:
        """Ids of words; those that hold the mark's text go one by one."""
        if self.mark is None or any(self.mark in w for w in words):
            return [np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
        ids = np.array(self.library.encode_batch_fast([self.mark.join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_id) * 4
        raw = ids.tobytes()
        if len(cuts) != len(words) - 1:
            raise ValueError("the tokenizer lost or added a mark")
        return [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        # split() also parts words at four separators that the tokenizer does not take for white space
        cut = [_GAP.findall(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        coded = [list(map(known.get, words)) for words in cut]
        new = list({w for words, codes in zip(cut, coded, strict=True) if None in codes for w, code in zip(words, codes, strict=True) if code is None})
        if new:
            fresh: dict[str, bytes] = {}
            for at in range(0, len(new), WORDS_A_CALL):
                some = new[at : at + WORDS_A_CALL]
                fresh.update(zip(some, self.code_new(some), strict=True))
            known.update((w, b) for w, b in fresh.items() if len(w) <= LONGEST_REMEMBERED)
            coded = [[fresh[w] if code is None else code for w, code in zip(words, codes, strict=True)] if None in codes else codes for words, codes in zip(cut, coded, strict=True)]
        return [b"".join(codes) for codes in coded]


def coder_at(path: str) -> WordCoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    return remembered(("words", path), lambda: WordCoder(path))
