"""Cost-balanced packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixfield.llm.batches import slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: So many words with their ids, of so many characters at most, are kept while a task runs: about 200 bytes each.
KNOWN_WORDS, KNOWN_LENGTH = 100_000, 32


@lru_cache(maxsize=1)
def _encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _added(ranks_path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern for the tokens that the tokenizer of the same name adds to the vocabulary, which it finds inside texts, and their ids."""
    with open(ranks_path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that depend on what is around them: {odd}")
    ids = {t["content"]: t["id"] for t in tokens}
    return (re.compile(f"({'|'.join(map(re.escape, sorted(ids, key=len, reverse=True)))})") if ids else None), ids


@lru_cache(maxsize=1)
def _known(ranks_path: str) -> dict[str, bytes]:
    """Ids of words that follow a space, while a task runs."""
    return {}


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[starts[i] : starts[i] + lengths[i]]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def tokenize(texts: list[str], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after the other, and the number of ids of each text.

    Texts are cut at the tokens that the tokenizer adds to its vocabulary, and what is between them is encoded by itself.
    """
    pattern, added = _added(ranks_path)
    cut = {i: pattern.split(text) for i, text in enumerate(texts) if any(x in text for x in added)}
    if not cut:
        return _ordinary(texts, ranks_path)
    parts = [cut.get(i, [text]) for i, text in enumerate(texts)]
    ids, counts = _ordinary([x for own in parts for x in own[::2]], ranks_path)
    flat, at, total, k = [], 0, np.zeros(len(texts), np.int64), 0
    for i, own in enumerate(parts):
        for j, x in enumerate(own):
            if j % 2:
                flat.append(np.array([added[x]], np.uint32))
            else:
                flat.append(ids[at : at + counts[k]])
                at += counts[k]
                k += 1
            total[i] += len(flat[-1])
    return np.concatenate(flat), total


def _ordinary(texts: list[str], ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """``tokenize`` for texts without added tokens.

    A space followed by anything but white space always begins a token of the byte-level pattern, so texts
    are cut there and each distinct word is encoded once. Texts in which white space follows a space are
    encoded whole.
    """
    encoding, known = _encoding(ranks_path), _known(ranks_path)
    whole, piece = encoding._core_bpe.encode_ordinary, encoding._core_bpe.encode_single_piece
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    bounds = parts.offsets.to_numpy()
    coded = parts.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)  # quicker than to_pylist
    words = words.tolist()
    encoded = list(map(known.get, words))
    if len(known) > KNOWN_WORDS:
        known.clear()
    odd, at = np.zeros(len(words), bool), -1
    while True:
        try:
            at = encoded.index(None, at + 1)
        except ValueError:
            break
        word = words[at]
        if word.isalpha():
            encoded[at] = array("I", piece((" " + word).encode())).tobytes()
            if len(word) <= KNOWN_LENGTH:
                known[word] = encoded[at]
        elif (stem := word[:-1]).isalpha() and word[-1] in ".,":
            first = known.get(stem)
            if first is None:
                first = array("I", piece((" " + stem).encode())).tobytes()
                if len(stem) <= KNOWN_LENGTH:
                    known[stem] = first
            encoded[at] = first + array("I", piece(word[-1:].encode())).tobytes()
        elif not word or word[0].isspace():
            encoded[at], odd[at] = b"", True
        else:
            encoded[at] = array("I", whole(" " + word)).tobytes()
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    starts = np.cumsum(lengths) - lengths
    ids = np.frombuffer(b"".join(encoded), np.uint32)
    flat: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    is_odd = odd[codes]
    is_odd[bounds[:-1]] = False  # the first word of a text has no space before it
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        if is_odd[a:b].any():
            flat.append(np.array(whole(text), np.uint32))
        else:
            rest = codes[a + 1 : b]
            flat.append(np.array(whole(words[codes[a]]), np.uint32))
            flat.append(_ragged(ids, starts[rest], lengths[rest]))
            counts[i] = len(flat[-2])
        counts[i] += len(flat[-1])
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), counts


def _power_of_two_parts(n: int) -> list[int]:
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


def assign(lengths: list[int], max_tokens: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start in it, length, sequence, offset)`` of documents that are shorter than a sequence.

    There are as many whole sequences as the tokens fill, and sequences of falling powers of two for what is
    over, so that none needs padding. The longest document goes first, each to the sequence of the lowest cost
    so far among those with room for it; a document that no sequence has room for is cut to fill the emptiest.
    """
    total = sum(lengths)
    room = np.array([max_tokens] * (total // max_tokens) + _power_of_two_parts(total % max_tokens), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    heap = [(-n, document, 0) for document, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    pieces = []
    while heap:
        size, document, start = heapq.heappop(heap)
        size = -size
        at = int(np.where(room >= size, cost, np.inf).argmin())
        if room[at] < size:
            at = int(room.argmax())
        taken = min(size, int(room[at]))
        pieces.append((document, start, taken, at, int(used[at])))
        room[at] -= taken
        used[at] += taken
        cost[at] += linear * taken + quadratic * taken * taken
        if taken < size:
            heapq.heappush(heap, (taken - size, document, start + taken))
    return pieces


def pack(docs: DataFrame, ranks_path: str, max_tokens: int = 1024, end_id: int = 0, window: int = 4096, linear: float = 1.0, quadratic: float = 1 / 256) -> DataFrame:
    """Packs every document of ``docs(doc_id, text)`` into sequences of at most ``max_tokens`` tokens.

    A document's tokens are those of its whole text (null: empty) and ``end_id``. It is cut into whole sequences
    as long as it fills them; the rests of ``window`` documents at a time are balanced by their estimated
    cost ``linear * n + quadratic * n * n`` (see ``assign``). A document is packed by the task that reads it, so
    nothing is shuffled, and a task that is run again on its part of the input gives the same pieces.

    One row for each piece: ``ids`` holds its token ids as little-endian unsigned 32-bit integers, ``start`` the
    number of its document's ids before it, ``offset`` its place in the sequence. An empty text or null gives a
    document of one token, repeated rows are packed once each, a null doc_id stays null, and other
    columns are dropped. ``max_tokens`` must be a power of two for sequences without padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple[int | None, int, int, np.ndarray]] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal sequence
            pieces = assign([len(r[3]) for r in rests], max_tokens, linear, quadratic)
            for k, start, n, at, offset in pieces:
                doc_id, before, tokens, ids = rests[k]
                rows.append((doc_id, before + start, n, ids[start : start + n].tobytes(), tokens, sequence + at, offset))
            sequence += max((p[3] for p in pieces), default=-1) + 1
            rests.clear()

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return batch

        for batch in slices(batches, 1):
            ids, counts = tokenize(batch.column(1).to_pylist(), ranks_path)
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                n += 1
                whole = n - n % max_tokens
                for start in range(0, whole, max_tokens):
                    rows.append((doc_id, start, max_tokens, own[start : start + max_tokens].tobytes(), n, sequence, 0))
                    sequence += 1
                if n > whole:
                    rests.append((doc_id, whole, n, own[whole:]))
                if len(rests) >= window:
                    close()
            yield out()
        close()
        _known(ranks_path).clear()  # workers are used again by other queries
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)

