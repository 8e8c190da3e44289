"""Alignment of two tokenizers over the same texts, by pointer jumping.

A text is encoded by a byte-level BPE (A) and by a sentencepiece model (B).  Both are sequences of byte
ranges of the text with a space in front.  Every token points to the token, of A or B, that reaches
farthest right of those it overlaps; doubling the pointers of a whole block of texts at once takes each
token to the last one of its component, which labels the groups between common token ends.

Texts travel as blocks of token ids.  A block asks for the corpus-wide counts of the id pairs it holds,
once for each distinct pair, and gets its own answers back; no task sees more than a block and no pair
has more rows than there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel.llm import pretokens
from watchpanel.llm.byte_bpe import Ranks, runs, trim
from watchpanel.llm.workers import handing_back
from watchpanel.sources.storage import scratch_path

#: bytes of texts that are encoded together; a longer text stands alone
BATCH_BYTES = 1 << 18
#: tokens of both kinds in a block; a longer text is a block of its own
BLOCK_TOKENS = 1 << 20
#: chunks of texts whose ids a Python worker keeps, and the longest of them
KEPT_CHUNKS, KEPT_CHARS = 250_000, 48
#: characters of new chunks that are encoded together
NEW_CHARS = 1 << 16
#: bits of a token id, and of a text's number in its block
ID_BITS = 21


class Encoders:
    """Both tokenizers, their tokens as bytes, and the chunks of texts seen so far."""

    def __init__(self, left: str | None, right: str | None):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        self.left = Ranks(left or public_tokenizers.path("byte_bpe_50k.json"))
        self.right = SentencePieceProcessor(model_file=right or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = list(map(self.right.id_to_piece, range(self.right.get_piece_size())))
        self.b_tokens = [
            bytes([int(p[3:-1], 16)]) if self.right.is_byte(i)
            else b"" if self.right.is_control(i) or self.right.is_unknown(i)
            else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes = self.left.sizes
        self.b_sizes = np.fromiter(map(len, self.b_tokens), np.int64, len(pieces))
        # a text's number in its block and an id pair share 63 bits
        if max(len(self.a_sizes), len(pieces)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies hold at most {1 << ID_BITS} tokens")
        self.kind = "<u2" if max(len(self.a_sizes), len(pieces)) <= 1 << 16 else "<u4"
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}
        # names of ids with what follows them in a list of groups
        a, b = range(len(self.a_sizes)), range(len(pieces))
        self.a_names = np.array([f"{i}," for i in a] + [f"{i}|" for i in a], dtype=object)
        self.b_names = np.array([f"{i}," for i in b] + [f"{i};" for i in b], dtype=object)

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of a text that begins with a space, and whether B gives its bytes; A always does."""
        (raw,) = self.left.encode([text])
        b = self.right.encode(text[1:])
        same = b"".join(map(self.b_tokens.__getitem__, b)) == text.encode()
        return np.frombuffer(raw, dtype="<u4"), np.array(b, dtype=np.int64), same

    def _alone(self, chunk: str) -> tuple[bytes, bytes] | None:
        a, b, same = self._both(chunk)
        return (a.astype(self.kind).tobytes(), b.astype(self.kind).tobytes()) if same else None

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of chunks, None where B changes the bytes.  Plain chunks are encoded in a row and parted after."""
        found = {}
        plain = []
        for c in chunks:
            # in a row, the next chunk's space must begin a token of its own
            if len(c) > 1 and _solid(c[1]) and _solid(c[-1]):
                plain.append(c)
            else:
                found[c] = self._alone(c)
        for begin, end in runs(list(map(len, plain)), NEW_CHARS):
            part = plain[begin:end]
            a, b, same = self._both("".join(part))
            ends = np.cumsum([len(c.encode()) for c in part])
            a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            a_cut, b_cut = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
            if not same or (a_ends[a_cut - 1] != ends).any() or (b_ends[b_cut - 1] != ends).any():
                found.update((c, self._alone(c)) for c in part)
                continue
            a_raw, b_raw = a.astype(self.kind).tobytes(), b.astype(self.kind).tobytes()
            size = np.dtype(self.kind).itemsize
            a_at, b_at = [0, *(size * a_cut).tolist()], [0, *(size * b_cut).tolist()]
            a_parts = map(a_raw.__getitem__, map(slice, a_at, a_at[1:]))
            found.update(zip(part, zip(a_parts, map(b_raw.__getitem__, map(slice, b_at, b_at[1:])))))
        return found

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text by A and B, packed; empty if the text is empty or B changes its bytes."""
        used = [i for i, t in enumerate(texts) if t]
        made = [(b"", b"")] * len(texts)
        if not used:
            return made
        # chunks begin at a space between characters that are no white space: neither side joins across it
        joined = "".join([" " + texts[i] for i in used])
        sizes = np.fromiter((len(texts[i]) + 1 for i in used), np.int64, len(used))
        start = np.cumsum(sizes) - sizes
        cps = pretokens.codepoints(joined)
        solid = _solid_table()[cps]
        cut = np.zeros(len(cps) + 1, dtype=bool)
        cut[1:-2] = (cps[1:-1] == 0x20) & solid[:-2] & solid[2:]
        cut[start] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        places = at.tolist()
        chunks = list(map(joined.__getitem__, map(slice, places, places[1:])))
        new = self.learn(list(set(chunks).difference(self.kept)))
        long = {c: x for c, x in new.items() if len(c) > KEPT_CHARS}
        self.kept.update(new)
        ids = list(map(self.kept.__getitem__, chunks))
        for c in long:
            del self.kept[c]
        trim(self.kept, KEPT_CHUNKS)
        first = np.searchsorted(at, np.append(start, len(cps))).tolist()
        for i, x, y in zip(used, first, first[1:]):
            own = ids[x:y]
            if None not in own:
                a, b = zip(*own)
                made[i] = b"".join(a), b"".join(b)
        return made


_solid_kept: np.ndarray | None = None


def _solid_table() -> np.ndarray:
    """Which codepoints are no white space for any tokenizer: no controls or separators, nor their stand-ins."""
    global _solid_kept
    if _solid_kept is None:
        table = pretokens.classes() != pretokens.SPACE
        table[:0x20] = False
        table[0x7F:0xA1] = False
        table[[0x180E, 0x2581, 0xFEFF]] = False
        table[0x2000:0x2070] = False
        _solid_kept = table
    return _solid_kept


def _solid(c: str) -> bool:
    return _solid_table()[ord(c)]


@cache
def encoders(left: str | None, right: str | None) -> Encoders:
    """Read once in a Python worker."""
    return Encoders(left, right)


class Aligned:
    """Groups and links of the texts of a block."""

    def __init__(self, known: Encoders, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.known, self.a, self.b, self.n_a, self.n_b = known, a, b, n_a, n_b
        # the texts follow one another, and both sides end together at the end of each
        self.a_end, self.b_end = np.cumsum(known.a_sizes[a]), np.cumsum(known.b_sizes[b])
        size = int(self.a_end[-1]) + 1 if len(a) else 1
        self.a_cut, self.b_cut = np.zeros(size, dtype=np.int8), np.zeros(size, dtype=np.int8)
        self.a_cut[self.a_end] = 1
        self.b_cut[self.b_end] = 1
        # tokens that end up to a byte: the number of the token that holds the next byte
        self.a_at, self.b_at = np.cumsum(self.a_cut, dtype=np.int32), np.cumsum(self.b_cut, dtype=np.int32)
        n = len(a)
        # a token's farthest-right overlapping token holds its last byte; of equal ends B's is the last
        after = np.empty(n + len(b), dtype=np.int32)
        after[:n] = n + self.b_at[self.a_end - 1]
        itself = np.arange(n, n + len(b), dtype=np.int32)
        after[n:] = np.where(self.a_cut[self.b_end], itself, self.a_at[self.b_end - 1])
        while True:
            farther = after[after]
            if np.array_equal(farther, after):
                break
            after = farther
        last = after[n:] == itself
        self.closes = last
        # components lie in the order of their last tokens
        number = np.cumsum(last) - 1
        self.a_group, self.b_group = number[after[:n] - n], number[after[n:] - n]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, id pair) of every overlapping pair of tokens: there is one between any two neighbouring ends."""
        ends = np.flatnonzero(self.a_cut | self.b_cut)
        i, j = self.a_at[ends - 1], self.b_at[ends - 1]
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)
        return text[i], self.a[i] << ID_BITS | self.b[j]

    def groups(self) -> list[str]:
        """Groups of each text: ids of A, a bar, ids of B; semicolons between groups."""
        known, n_groups = self.known, int(self.closes.sum())
        in_a, in_b = np.bincount(self.a_group, minlength=n_groups), np.bincount(self.b_group, minlength=n_groups)
        a_before, b_before = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        names = np.empty(len(self.a) + len(self.b), dtype=object)
        ends = np.zeros(len(self.a), dtype=np.int64)
        ends[a_before + in_a - 1] = 1
        names[np.arange(len(self.a)) + b_before[self.a_group]] = known.a_names[self.a + ends * len(known.a_sizes)]
        place = np.arange(len(self.b)) + (a_before + in_a)[self.b_group]
        names[place] = known.b_names[self.b + self.closes * len(known.b_sizes)]
        names, at, made = names.tolist(), 0, []
        for n in (self.n_a + self.n_b).tolist():
            made.append("".join(names[at : at + n])[:-1])
            at += n
        return made

    def groups_per_text(self) -> np.ndarray:
        text = np.repeat(np.arange(len(self.n_b)), self.n_b)
        return np.bincount(text[self.closes], minlength=len(self.n_b))


def _of_block(known: Encoders, row: dict) -> Aligned:
    counts = [np.array(row[c], dtype=np.int64) for c in ("n_a", "n_b")]
    width = np.dtype(known.kind).itemsize
    packed = (pa.decompress(row[c], int(n.sum()) * width, codec="zstd") for c, n in zip(("a", "b"), counts))
    a, b = (np.frombuffer(x, dtype=known.kind).astype(np.int64) for x in packed)
    return Aligned(known, a, b, *counts)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a table of the shared folder."""
    path = scratch_path(df.sparkSession, name)
    # rows of blocks are large: small row groups keep the writer small
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def token_blocks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, left: str | None = None, right: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(block, keys, n_a, n_b, a, b): ids of consecutive texts, packed little-endian integers (`Encoders.kind`), zstd.

    Written to a table, which fixes the blocks.  Null and empty texts, and texts that B does not give
    back byte by byte, have no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoders(left, right)
        width = np.dtype(known.kind).itemsize
        pack = pa.Codec("zstd", compression_level=4)
        number = TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0

        def block() -> pa.RecordBatch:
            a, b = [x for x, _ in ids], [y for _, y in ids]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([keys], pa.list_(key_type)),
                    pa.array([[len(x) // width for x in a]], pa.list_(pa.int32())),
                    pa.array([[len(x) // width for x in b]], pa.list_(pa.int32())),
                    *[pa.array([pack.compress(b"".join(x), asbytes=True)], pa.binary()) for x in (a, b)],
                ],
                names=["block", "keys", "n_a", "n_b", "a", "b"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            for x, y in runs(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(x, y - x).to_pylist()]
                for k, pair in zip(batch.column(0).slice(x, y - x).to_pylist(), known.encode(texts)):
                    size = (len(pair[0]) + len(pair[1])) // width + 1
                    if keys and held + size > block_tokens:
                        yield block()
                        number, keys, ids, held = number + 1, [], [], 0
                    keys.append(k)
                    ids.append(pair)
                    held += size
        if keys:
            yield block()

    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    schema = f"block long, keys array<{kind}>, n_a array<int>, n_b array<int>, a binary, b binary"
    return _stored(source.mapInArrow(handing_back(run), schema), "token-blocks")


def block_pairs(blocks: DataFrame, *, left: str | None = None, right: str | None = None) -> DataFrame:
    """(block, pair, docs): texts of the block that hold an id pair linked; a pair is a << ID_BITS | b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoders(left, right)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                text, pair = _of_block(known, row).links()
                each = np.sort(text << 2 * ID_BITS | pair)
                each = each[np.append(True, each[1:] != each[:-1])[: len(each)]] & ((1 << 2 * ID_BITS) - 1)
                pairs, docs = np.unique(each, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), row["block"])), pa.array(pairs), pa.array(docs.astype(np.int64))],
                    names=["block", "pair", "docs"],
                )

    return _stored(blocks.mapInArrow(handing_back(run), "block long, pair long, docs long"), "block-pairs")


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, docs, best) of the pairs of all blocks: texts of the corpus, and whether no pair of its A id has more."""
    counts = _stored(asked.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    a = F.shiftright("pair", ID_BITS)
    # one row for each id of A's vocabulary at most, whatever the corpus
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("highest"))
    met = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    return met.select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, left: str | None = None, right: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    `left` is a byte-level BPE file (A), `right` a sentencepiece model (B); without them the installed
    byte_bpe_50k.json and piece_bpe_32k.model.  A encodes the text with a space in front, B adds its own.
    n_groups: byte ranges between common token ends; n_links: overlapping pairs of an A and a B token;
    a pair's count: texts of `docs` that hold its ids linked; n_best: links whose count is the highest of
    their A id, ties included; count_sum: counts over all links; groups: `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and texts that B does not give back byte by byte, have zeros and an empty
    `groups`.  Keys may be null, repeated rows count like other texts, an empty table gives an empty one,
    other columns are left out, whatever their names.  A task holds a block, or one longer text.
    """
    blocks = token_blocks(docs, key, text, left=left, right=right, block_tokens=block_tokens)
    asked = block_pairs(blocks, left=left, right=right)
    answers = asked.select("block", "pair").join(pair_counts(asked), "pair")

    def run(own: pa.Table, answer: pa.Table) -> pa.Table:
        known = encoders(left, right)
        pairs, docs_, best = (answer.column(c).to_numpy() for c in ("pair", "docs", "best"))
        order = np.argsort(pairs)
        pairs, docs_, best = pairs[order], docs_[order], best[order].astype(np.int64)
        (row,) = own.to_pylist()
        found = _of_block(known, row)
        text_of, pair = found.links()
        at = np.searchsorted(pairs, pair)
        first = np.searchsorted(text_of, np.arange(len(found.n_a) + 1))

        def sums(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return total[first[1:]] - total[first[:-1]]

        return pa.table({
            "k": pa.array(row["keys"], own.schema.field("keys").type.value_type),
            "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.groups_per_text(), "n_links": np.diff(first),
            "n_best": sums(best[at]), "count_sum": sums(docs_[at]), "groups": pa.array(found.groups(), pa.string()),
        })

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    numbers = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    joined = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return joined.applyInArrow(run, f"k {kind}, {numbers}, groups string").withColumnRenamed("k", key)
