"""Loading of public tokenizer files inside tasks, and bounded per-worker memories of pieces."""

from __future__ import annotations

import os

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: The split of byte-level BPE, with Unicode white space spelled out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

_LOADED: dict = {}


def file_of(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: below ``folder`` if given, else where the installed package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(name: str, folder: str | None = None):
    """The library's tokenizer for a vocabulary file, once per worker, single-threaded as Spark owns the cores."""
    key = (name, folder)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file_of(name, folder))
        t.no_truncation()
        t.no_padding()
        _LOADED[key] = t
    return _LOADED[key]


class Memory(dict):
    """A bounded memo: ``make(key)`` fills a missing key; when full, the older half is forgotten. Keys longer than
    ``longest`` are made each time."""

    def __init__(self, make, limit: int, longest: int = 1 << 16):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def add(self, values: dict) -> None:
        """Remember many at once."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self.update(values)

    def __setitem__(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        super().__setitem__(key, value)
