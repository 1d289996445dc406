"""Whole-text encoding inside Spark tasks: by way of distinct pieces, or by a vocabulary file.

Byte-level vocabularies split a text by PATTERN and encode each match on its own.  A space or line
break followed by something other than white space always starts a match, so texts can be cut there first:
the pieces, words mostly, repeat a lot.  A batch is cut with Arrow kernels, its distinct pieces are
looked up in a bounded cache, only unknown ones are encoded, and the ids of the batch are gathered
with numpy.  Texts where a space or line break is followed by other white space, or that end in two
white space characters, are cut by a slower expression with the same property.

Defined cases: a null text is encoded as an empty one (no ids); strings that name special tokens
are ordinary text, or, in a VocabularyCoder with ``added``, the file's added tokens, as the library takes them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that either Python or the vocabularies' own libraries take as white space.
_WS = r"\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CAREFUL = f"[ \\n][{_WS}]|[{_WS}][ \\n]\\z"
_MARKS = frozenset(".,;:!?")
#: UTF-8 bytes of text that are encoded at once, and pieces that a worker remembers.
BATCH_BYTES, CACHE_PIECES = 6_000_000, 700_000


def slices(table: pa.RecordBatch | pa.Table, column: str, most: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """The rows in consecutive slices of at most ``most`` bytes of text, one row at least."""
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    if not table.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    at, done = 0, 0
    while at < table.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield table.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


class PieceCoder:
    """Encodes batches of texts by way of their distinct pieces.

    ``split`` cuts a text into the pattern's matches; ``encode_new(pieces, cache)`` maps pieces to
    little-endian 32-bit id strings.
    """

    def __init__(self, split: Callable[[str], list[str]], encode_new: Callable[[list[str], dict], list[bytes]], cache_pieces: int = CACHE_PIECES):
        self.split, self.encode_new, self.cache_pieces = split, encode_new, cache_pieces
        self.cache: dict[str, bytes] = {}

    def look_up(self, pieces: list[str]) -> list[bytes]:
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if new:
            if len(cache) + len(new) > self.cache_pieces:
                found = {p: cache[p] for p in pieces if p in cache}
                cache.clear()
                cache.update(found)
            cache.update(zip(new, self.encode_new(new, cache), strict=True))
        return [cache[p] for p in pieces]

    def pieces(self, texts: pa.ChunkedArray | pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the code of each piece of the batch in order, and pieces per text."""
        texts = pc.fill_null(texts, "")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        slow = pc.match_substring_regex(texts, _CAREFUL).to_numpy(zero_copy_only=False)
        quick = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(quick).to_numpy().astype(np.int64)
        starts = np.cumsum(counts) - counts
        encoded = pc.dictionary_encode(pc.list_flatten(quick))
        words, codes = encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy().astype(np.int64)
        # After the first piece of a text each has its space back, or begins with its line break; first pieces get codes of their own.
        distinct = [w if w[:1] == "\n" else " " + w for w in words]
        firsts = codes[starts]
        heads, back = np.unique(firsts, return_inverse=True)
        distinct += [words[i] for i in heads]
        codes[starts] = len(words) + back
        if slow.any():
            seen: dict[str, int] = {}
            parts, rows = [], np.flatnonzero(slow)
            for row in rows.tolist():
                own = [seen.setdefault(p, len(distinct) + len(seen)) for p in self.split(texts[row].as_py())]
                parts.append(np.array(own, dtype=np.int64))
            distinct += seen
            at = 0
            merged = []
            for row, part in zip(rows.tolist(), parts, strict=True):
                merged += [codes[at : starts[row]], part]
                at = starts[row] + counts[row]
                counts[row] = len(part)
            codes = np.concatenate([*merged, codes[at:]])
        return distinct, codes, counts

    def encode(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch (uint32, in order) and the number of ids of each text."""
        distinct, codes, counts = self.pieces(texts)
        used = np.zeros(len(distinct), dtype=bool)
        used[codes] = True
        number = np.cumsum(used) - 1
        coded = self.look_up([p for p, u in zip(distinct, used.tolist(), strict=True) if u])
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        codes = number[codes]
        ids = np.frombuffer(b"".join(map(coded.__getitem__, codes.tolist())), dtype="<u4")
        return ids, sums(sizes[codes], counts)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; run i has counts[i] items, perhaps none."""
    edges = np.concatenate([[0], np.cumsum(values)])
    upto = np.cumsum(counts)
    return edges[upto] - edges[upto - counts]


def match_finder(pattern: str) -> Callable[[str], list[str]]:
    """findall of a vocabulary's pattern.  Its library takes ``\\s`` as Unicode white space, which Python's engines widen."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def matches(piece: str, split: Callable[[str], list[str]]) -> list[str]:
    """The pattern's matches of a piece; letters, perhaps before one mark, need no pattern."""
    if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
        return [piece]
    body, mark = piece[:-1], piece[-1:]
    if mark in _MARKS and (body.isalpha() or (body[:1] == " " and body[1:].isalpha())):
        return [body, mark]
    return split(piece)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class VocabularyCoder:
    """Encodes texts by a byte-level vocabulary file of the tokenizers library, with the ids that library gives.

    The file's merges stand in the order of their ids, so a rank encoder finds the same contractions, faster.
    ``added`` tells whether the file's added tokens are found in texts, as the library does once it has loaded
    the file.  A text that the rank encoder refuses, as one with a million spaces in a row, goes through the
    library itself.
    """

    def __init__(self, path: str, added: bool):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, byte_of = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        tokens = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if merged != sorted(set(merged)) or spec["normalizer"] or any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: ids don't follow the merges, or texts or added tokens are normalised")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in tokens}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=tokens)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.allowed = set(tokens) if added else set()

    def encode_one(self, text: str) -> np.ndarray:
        try:
            return self.coder.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        return [self.encode_one(text or "") for text in texts.to_pylist()]


_CODERS: dict[tuple[str, bool], VocabularyCoder] = {}


def vocabulary_coder(path: str, added: bool = False) -> VocabularyCoder:
    """The coder of a vocabulary file; one in each worker process."""
    if (path, added) not in _CODERS:
        _CODERS[path, added] = VocabularyCoder(path, added)
    return _CODERS[path, added]
