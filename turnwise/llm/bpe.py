"""Byte-pair encoding of whole texts through the tokenizers library, remembering pieces between white space.

Byte-level BPE never merges across a space that follows a visible character, so
a text falls into pieces that are encoded on their own. A worker keeps the ids of
the pieces it met in one table; texts are split, and their distinct pieces found, by Arrow; new
pieces go to the library; and the ids of a batch are gathered from the table. The table is
bounded and starts afresh when full.

Pieces of letters and ASCII punctuation go to the library's BPE model without its
pre-tokenizer, which would only cut between letters and punctuation: where no
token of the vocabulary holds both (checked once), no merge crosses such a cut.
A text that holds the string of an added token, such as the end of text, is
encoded whole, as the library gives such strings their own ids.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from turnwise.llm.common import tidy

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Pieces in the table, and the longest that it keeps.
CACHE_PIECES = 1_000_000
CACHED_CHARS = 48
#: Bytes of text that are encoded at once; small batches are put together up to it.
MANY_BYTES = 4 << 20
#: Characters that the library encodes at once.
LIBRARY_CHARS = 1 << 18

#: Any white space before a space: such texts are encoded whole.
_ODD = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"  # ASCII without the apostrophe, which begins contractions
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"  # written with the bytes A-Z, a-z, 0x80 to 0xBF and 0xC3 to 0xC9
_PLAIN = re.compile(rf"[{_LETTERS}{_PUNCTUATION}]+(?:\n[{_LETTERS}{_PUNCTUATION}]+)*\Z")


def byte_characters() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself where it is printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids that the library gives with add_special_tokens=False: strings of added tokens in a text have the tokens' ids."""

    def __init__(self, tokenizer: str = TOKENIZER, cache_pieces: int = CACHE_PIECES, many_bytes: int = MANY_BYTES):
        self.cache_pieces, self.many_bytes = cache_pieces, many_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path(tokenizer))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        before = self.tokenizer.pre_tokenizer
        if not isinstance(before, ByteLevel) or self.tokenizer.normalizer is not None or not before.use_regex or before.add_prefix_space:
            raise ValueError("the tokenizer must be a byte-level one without normalizer and prefix space")
        self.model = Tokenizer(self.tokenizer.model)
        written = byte_characters()
        self.written = {b: c for b, c in enumerate(written) if ord(c) != b}
        self.space, self.line = written[32], written[10]
        self.plain = self._no_token_crosses(written)
        self._fresh()

    def _fresh(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _no_token_crosses(self, written: list[str]) -> bool:
        """Whether no token made of plain pieces' bytes holds letters and punctuation, or a line feed and anything else."""
        letter = "A-Za-z" + re.escape("".join(written[0x80:0xC0] + written[0xC3:0xCA]))
        possible = re.compile(rf"{self.space}?[{letter}{_PUNCTUATION}{self.line}]+")
        kinds = [re.compile(f"[{k}]") for k in (letter, _PUNCTUATION, self.line)]
        special = set(self.added)  # no merge makes these
        return not any(possible.fullmatch(t) and sum(bool(k.search(t)) for k in kinds) > 1 for t in self.tokenizer.get_vocab() if t not in special)

    def _library(self, texts: list[str], model: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the texts, one after the other, and how many each has, in parts. The library's results are many times the text, so it gets little at once."""
        encode = (self.model if model else self.tokenizer).encode_batch_fast
        ids, sizes, first, size = [], [], 0, 0
        for at, length in enumerate(map(len, texts)):
            size += length
            if size >= LIBRARY_CHARS or at + 1 == len(texts):
                lists = [e.ids for e in encode(texts[first : at + 1], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
                first, size = at + 1, 0
        return ids, sizes

    def _new(self, pieces: list[str], firsts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, each after a space, and of whole texts: where each begins and how many it has. The texts' come last."""
        match, table, space, line = _PLAIN.match, self.written, self.space, self.line
        plain = np.fromiter((self.plain and match(x) is not None for x in pieces), bool, len(pieces))
        words = [space + (x.replace("\n", line) if x.isascii() else x.encode().decode("latin-1").translate(table)) for x, y in zip(pieces, plain, strict=True) if y]
        parts = [self._library(words, model=True), self._library([" " + x for x, y in zip(pieces, plain, strict=True) if not y]), self._library(firsts)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(x for p in parts for x in p[0])])
        sizes = np.concatenate([np.zeros(0, np.int64), *(x for p in parts for x in p[1])])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain), len(pieces) + np.arange(len(firsts))])
        start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        start[order], size[order] = np.cumsum(sizes) - sizes, sizes
        return ids, start, size

    def _many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(bool)
        for content in self.added:
            odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False).astype(bool)
        whole = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(whole, " ")
        flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        # a text's first piece has no space before it
        firsts = flat.take(pa.array(at[:-1])).to_pylist()
        for i in np.flatnonzero(odd).tolist():
            firsts[i] = texts[i].as_py()
        code = pc.index_in(flat, value_set=self.known)
        if len(self.known) and (len(self.known) + code.null_count > self.cache_pieces or len(self.ids) > 8 * self.cache_pieces):
            self._fresh()
            code = pc.index_in(flat, value_set=self.known)
        coded = flat.filter(code.is_null()).dictionary_encode()
        lacks, known = coded.dictionary, len(self.known)
        more, at_new, size_new = self._new(lacks.to_pylist(), firsts)
        texts_from = int(at_new[len(lacks)]) if len(firsts) else len(more)
        del firsts
        old = len(self.ids)
        ids = np.concatenate([self.ids, more])
        start, size = np.concatenate([self.start, old + at_new]), np.concatenate([self.size, size_new])
        row = code.fill_null(-1).to_numpy().copy()
        row[row < 0] = known + coded.indices.to_numpy()
        row[at[:-1]] = known + len(lacks) + np.arange(len(texts))
        del whole, lists, flat, code, coded
        of = size[row].astype(np.int32)  # a part has some millions of ids at most
        ends = np.cumsum(of, dtype=np.int64)
        place = np.repeat((start[row] - (ends - of)).astype(np.int32), of)
        place += np.arange(len(place), dtype=np.int32)
        out = ids[place]
        del row, of, place
        keep = np.flatnonzero(pc.less_equal(pc.utf8_length(lacks), CACHED_CHARS).to_numpy(zero_copy_only=False))
        self.known = pa.concat_arrays([self.known, lacks.take(pa.array(keep))])
        keep = np.concatenate([np.arange(known), known + keep])
        self.ids, self.start, self.size = ids[: old + texts_from].copy(), start[keep], size[keep]
        return out, np.concatenate([[0], ends[at[1:] - 1]])

    def encode_many(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (null: empty), ``end_id`` after each, as little-endian uint32, and the offsets of the texts in them."""
        texts = pc.fill_null(texts, "")
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of new lists, none of them in a cycle
        try:
            return self._in_parts(texts, end_id)
        finally:
            if collects:
                gc.enable()

    def _in_parts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        into = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // self.many_bytes
        cuts = [0, *(np.flatnonzero(np.diff(into)) + 1).tolist(), len(texts)]
        parts, offsets, base = [], [np.zeros(1, np.int64)], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            ids, at = self._many(texts.slice(a, b - a))
            last = at[1:] + np.arange(b - a)
            out = np.full(len(ids) + b - a, end_id, "<u4")
            plain = np.ones(len(out), bool)
            plain[last] = False
            out[plain] = ids
            parts.append(out)
            offsets.append(base + last + 1)
            base += len(out)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.concatenate(offsets)


def put_together(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about MANY_BYTES of text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= MANY_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
            tidy()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        held = []
    tidy()


@lru_cache(maxsize=1)
def encoder(tokenizer: str = TOKENIZER, cache_pieces: int = CACHE_PIECES, many_bytes: int = MANY_BYTES) -> Encoder:
    """One encoder a worker process, so that its table outlives a task."""
    return Encoder(tokenizer, cache_pieces, many_bytes)
