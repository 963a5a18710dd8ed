"""Token ids of whole texts by a public byte-level BPE, with a bounded cache of pieces."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that isn't a space before a visible character, one newline or two; or the mark of a text's start.
_NOT_PLAIN = "  | \n|\n |\n\n\n|^[ \n]|[ \n]\\z|[\\x01\t\r\x0b\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

#: Latin letters only, which all versions of Unicode's tables agree on.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")


class PieceEncoder:
    """Encodes texts as the tokenizer does, but each distinct piece once.

    The byte-level pre-tokenizer never joins characters across a single space that stands before a character
    that is not white space, and it keeps a lone newline, or each of two, apart. So texts whose white space is
    only such spaces and newlines are cut at spaces, and their pieces are encoded on their own and kept, at
    about ``cache`` of them; when there are more the store starts anew with those of the batch at hand. All other texts, and those in which an
    added token of the vocabulary stands, go to the tokenizer whole. Both ways give the ids of the library's plain ``encode``.
    """

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.not_plain = "|".join([_NOT_PLAIN, *added])
        self.newline = self._whole(["\n"])[0][0]
        self.marks = {m: self._whole([m])[0][0] for m in ",."}
        # byte-level models write a byte that can't be seen as the next free character from U+0100 on
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.visible = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}
        self.cache = cache
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        base, n = self.used, len(self.number)
        self.used += len(ids)
        for name, new, old in (("ids", ids, base), ("starts", starts + base, n), ("lengths", lengths, n)):
            if old + len(new) > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * (old + len(new))))
            getattr(self, name)[old : old + len(new)] = new
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _add_words(self, pieces: list[str]) -> None:
        """Words of letters after a space are one unit to the pre-tokenizer, so the model alone cuts them."""
        cut = self.tokenizer.model.tokenize
        space, table = chr(self.visible[32]), self.visible
        lists = [[t.id for t in cut(space + (p if p.isascii() else p.encode().decode("latin-1").translate(table)))] for p in pieces]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        self._store(pieces, ids, np.cumsum(lengths) - lengths, lengths)

    def _add_ended(self, pieces: list[str]) -> None:
        """Such words with a comma or full stop: the known word's ids, and the mark's."""
        base = np.fromiter((self.number[p[:-1]] for p in pieces), np.int64, len(pieces))
        lengths = self.lengths[base] + 1
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[base] - (ends - lengths), lengths) + np.arange(ends[-1])]
        ids[ends - 1] = np.fromiter((self.marks[p[-1]] for p in pieces), np.uint32, len(pieces))
        self._store(pieces, ids, ends - lengths, lengths)

    def _add_others(self, pieces: list[str]) -> None:
        """One text with a line for each costs less than an item for each.

        A piece stands after a space, or begins with its newline; the mark shows a text's first piece. Pieces have
        no other white space, so the lines' newlines are tokens of their own and appear nowhere else.
        """
        bare = [p[1:] if p[:1] in ("\n", "\x01") else f" {p}" for p in pieces]
        ids = np.array(self._whole(["\n" + "\n".join(filter(None, bare))])[0], np.uint32)
        full = np.fromiter(map(bool, bare), bool, len(bare))
        led = np.fromiter((p[:1] == "\n" for p in pieces), np.int64, len(pieces))
        at = np.flatnonzero(ids == self.newline)[: int(full.sum())]
        starts, lengths = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[full], lengths[full] = at + 1, np.diff(np.append(at, len(ids))) - 1
        self._store(pieces, ids, starts - led, lengths + led)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        fresh = [p for p in pieces if p not in self.number]
        if fresh and len(self.number) + 2 * len(fresh) > self.cache:
            # the store starts anew with what this batch needs of it
            kept = [p for p in pieces if p in self.number]
            at = np.fromiter(map(self.number.__getitem__, kept), np.int64, len(kept))
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
            self._reset()
            self._store(kept, ids, ends - lengths, lengths)
        kinds: tuple[list, list, list] = ([], [], [])
        for p in fresh:
            kinds[0 if _LETTERS.fullmatch(p) else 1 if _LETTERS.fullmatch(p, 0, len(p) - 1) and p[-1] in self.marks else 2].append(p)
        if words := list({*kinds[0], *(b for p in kinds[1] if (b := p[:-1]) not in self.number)}):
            self._add_words(words)
        if kinds[1]:
            self._add_ended(kinds[1])
        for k in range(0, len(kinds[2]), 4096):
            self._add_others(kinds[2][k : k + 4096])
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the ends of each text's ids in it. Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.not_plain)
        mark, none = pa.scalar("\x01", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.if_else(odd, none, texts), none)
        cut = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(total)]
        offsets = cut.offsets.to_numpy()
        ends = np.concatenate([[0], ends])[offsets[1:] - offsets[0]]
        if rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            parts, whole = np.split(flat, ends[:-1]), {}
            for row in rows:
                whole[row] = np.array(self._whole([texts[row].as_py()])[0], np.uint32)
            parts = [whole.get(k, x) for k, x in enumerate(parts)]
            flat, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return flat, ends


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, as long as its tasks encode."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def batches_of(batch: pa.RecordBatch, text: int, most_bytes: int = 8 << 20):
    """Slices of a batch of whole rows with about most_bytes of text each, so that memory follows the longest text only."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
    slots = (np.cumsum(sizes) // most_bytes).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            # concatenating copies: some kernels misread a slice that does not begin at its buffer's start
            yield pa.record_batch([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], names=batch.schema.names)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
