"""Text to token ids inside tasks, with tokenizer files read once by the driver.

An encoder travels as a broadcast and is set up at its first use in a worker; what it has
learned of words stays there for later tasks.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain, repeat
from pathlib import Path

import numpy as np


class WordEncoder:
    """Encodes with the tokenizer of ``word_bpe_49k.json``, piece by piece.

    Its pre-tokenizer cuts a text into pieces that are encoded one by one, and drops white
    space. Texts of Latin letters, ASCII and common signs are cut here in the same way, any
    other text at ASCII white space only; the tokenizer sees every piece once and its ids are
    kept in flat arrays. At most KNOWN pieces are kept, which changes the speed only.
    """

    KNOWN = 1_500_000
    # Control characters are no white space for the tokenizer and fall into the last class of
    # PIECE, as they do there. The file's pre-tokenizer pattern for the letters of PLAIN.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\t-\r a-zß-öø-ÿœ0-9]+")
    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿŒœ«»–—‘’“”…·]*+")
    SPECIAL = "<|"        # special ids are looked for in the text as it stands
    WORD_END = "</w>"     # fixed value: the file's mark of a word's last id

    def __init__(self, path: str) -> None:
        self.data = Path(path).read_text()
        self.tokenizer = None

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _cut(self, text: str | None) -> tuple[list[str], bool]:
        """Pieces, and whether the tokenizer sees each as one word."""
        if not text:
            return [], True
        if (text.isascii() or self.PLAIN.fullmatch(text)) and self.SPECIAL not in text:
            return self.PIECE.findall(text.lower()), True
        return [w.decode() for w in text.encode().split()], False

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. They go in long lines, told apart
        by the ids that end a word: half the time of a call for each."""
        lines = [" ".join(words[i:i + 1_000]) for i in range(0, len(words), 1_000)]
        ids = self._flat(lines)[0]
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._flat(words)
        return ids, np.diff(ends, prepend=0)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, single: set[str], other: set[str]) -> None:
        for words, ids_of in ((list(single), self._ids_of), (list(other - single), self._flat)):
            for at in range(0, len(words), 20_000):
                part = words[at:at + 20_000]
                self._keep(part, *ids_of(part))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, end = len(self.known), self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.pool[self.used:end] = ids
        self.starts[first:first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:first + len(words)] = sizes
        self.known.update(zip(words, range(first, first + len(words))))
        self.used = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_str(self.data)
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for w, i in vocabulary.items() if w.endswith(self.WORD_END)]] = True
            self._clear()
        if len(self.known) > self.KNOWN:
            self._clear()
        cut, plain = zip(*map(self._cut, texts)) if texts else ((), ())
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            single = np.repeat(plain, [len(w) for w in cut])[unknown]
            self._learn({flat[i] for i in unknown[single]}, {flat[i] for i in unknown[~single]})
            at[unknown] = [self.known[flat[i]] for i in unknown]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - ends + sizes, sizes)
                        + np.arange(ends[-1] if len(ends) else 0)]
        counts = np.cumsum([0] + [len(w) for w in cut])
        bounds = np.concatenate([[0], ends])[counts]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


class RankEncoder:
    """Encodes with a file of byte-pair ranks; no text ever gives an id beyond the ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        self.data, self.pattern = Path(path).read_bytes(), pattern
        self.encoding = None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.encoding is None:
            import tiktoken
            ranks = {base64.b64decode(a): int(b)
                     for a, b in map(bytes.split, self.data.splitlines())}
            self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern,
                                              mergeable_ranks=ranks, special_tokens={})
        code = self.encoding.encode_ordinary
        return [np.array(code(t) if t else [], np.uint32) for t in texts]


def word_encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    import public_tokenizers
    return WordEncoder(public_tokenizers.path(name))


def rank_encoder(name: str = "byte_bpe_50k.tiktoken") -> RankEncoder:
    import public_tokenizers
    return RankEncoder(public_tokenizers.path(name), public_tokenizers.PATTERN)
