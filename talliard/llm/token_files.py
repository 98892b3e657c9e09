"""Token-id output: one wavelet matrix per shard, in one compressed file that answers queries by itself.

Documents are range-partitioned by doc_id and encoded in that order. A shard takes documents until it holds
SHARD_TOKENS ids and becomes one file: ids are renumbered by their count in the shard, so that high bit planes are
nearly empty, and stored as a wavelet matrix, plane by plane, each compressed, with a directory of set bits for
rank. TokenFile reads such a file: access(i), count(id), rank(id, i), select(id, k), document(k), all ids at once.
The files are rows of a Parquet table in any store that Spark can write to (shard and file order, number of ids,
bytes), so commits and retries are Spark's.

Where the loaded tokenizer's normalizer, splitter and special tokens are those for which no composition, match or
token crosses a blank or line feed (parts_at_blanks), each distinct word of the pieces between these is encoded once
while a bounded table of words lasts, and the ids of pieces are joined; tests hold this against whole texts of letters
that compose, marks, digits and special tokens. With any other tokenizer whole texts are encoded.
Arrow splits some BYTES of text and finds their distinct pieces, so that Python sees each of these once. Words new to a
worker go to the tokenizer's model many at once, in one string: an id that ends a word tells them apart.

Null and empty texts hold the end id only. A null doc_id is written as NO_ID, the smallest long, and read as null. Documents with the same doc_id follow each other by text, null first;
equal rows are alike. An empty table gives no file and no rows. Other columns are ignored.
"""

import io
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talliard.llm.chunks import NO_ID
from talliard.llm.common import parts, scratch, texts
from talliard.tables import table

MAGIC = b"TWM1"
END_ID = 2
#: Ids in a shard, but for its last document.
SHARD_TOKENS = 1 << 22
#: Words that a worker learns or meets before it starts over; it keeps the ones of the time before, unless they are four times as many.
WORDS = 150_000
#: Words that the model gets at once.
AT_ONCE = 10_000
#: Letters of a text by which equal doc_ids are dealt.
BEGIN = 512
#: Bytes of texts that are in pieces at once, but for one more text; whole texts that are encoded at once.
BYTES, TEXTS = 4 << 20, 32
#: Marks behind letters; the end of the Latin letters that neither composing nor folding changes into anything but one letter, but for one.
MARKS, LATIN, FALLS_APART = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "\u0250", "\u0130"
#: Small letters of Latin-1; Latin-1 in small letters, with line feeds as blanks, by byte.
WORD = "^[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+$"
SMALL = bytes(range(256)).decode("latin-1").replace("\n", " ").lower().encode("latin-1")
#: A normalizer that neither moves nor drops anything across a blank, and a splitter whose matches hold none.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bits for each entry of a plane's directory; ids that are parted by a bit at once, by their places, which is faster than by a mask.
RANK_BITS, PARTED = 4096, 1 << 16


def parts_at_blanks(tokenizer: dict) -> bool:
    """Whether a tokenizer, given as its file's JSON, encodes a text as its pieces between blanks and line feeds one by one."""
    splits = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        tokenizer.get("normalizer") == {"type": "Sequence", "normalizers": NORMALIZERS}
        and splits[0] == {"type": "Split", "pattern": {"Regex": SPLITTER}, "behavior": "Removed", "invert": True}
        and splits[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(t["content"].split()) != 1 for t in tokenizer["added_tokens"])
    )


def spans(n: int) -> list[slice]:
    return [slice(at, at + PARTED) for at in range(0, n, PARTED)]


def write_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of one shard's file."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    used = np.flatnonzero(counts)
    alphabet = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    code = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    rest = code[ids]
    n_planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    out = io.BytesIO()

    def put(data: bytes) -> None:
        out.write(struct.pack("<Q", len(data)))
        out.write(data)

    out.write(MAGIC + struct.pack("<QQQQ", len(ids), len(doc_ids), len(alphabet), n_planes))
    put(pack(doc_ids.astype("<i8").tobytes()))
    put(pack(lengths.astype("<u4").tobytes()))
    put(pack(alphabet.tobytes()))
    for b in reversed(range(n_planes)):
        bit = (rest & rest.dtype.type(1 << b)) != 0
        packed = np.packbits(bit)
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), RANK_BITS // 8), dtype=np.int64)
        put(pack(packed.tobytes()))
        put(pack(np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes()))
        rest = np.concatenate([rest[at][np.flatnonzero(bit[at] == one)] for one in (False, True) for at in spans(len(rest))])
    return out.getvalue()


class TokenFile:
    """Queries on one file's bytes."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n, n_docs, n_codes, n_planes = struct.unpack_from("<QQQQ", data, 4)
        at, unpack = 36, zstandard.ZstdDecompressor().decompress

        def get(kind: str) -> np.ndarray:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return np.frombuffer(unpack(data[at - size : at]), kind)

        self.doc_ids, self.lengths, self.alphabet = get("<i8"), get("<u4"), get("<u4")
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))
        self.planes = [(get("u1"), get("<u4")) for _ in range(n_planes)]
        self.codes = {int(t): c for c, t in enumerate(self.alphabet)}

    def _ones(self, plane: int, i: int) -> int:
        """Set bits before place i of a plane."""
        bits, directory = self.planes[plane]
        block = i // RANK_BITS
        first, whole = block * RANK_BITS // 8, i // 8
        ones = int(directory[block]) + int(np.bitwise_count(bits[first:whole]).sum(dtype=np.int64))
        return ones + (int(bits[whole] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _zeros(self, plane: int) -> int:
        return self.n - int(self.planes[plane][1][-1])

    def access(self, i: int) -> int:
        code = 0
        for p in range(len(self.planes)):
            bit = int(self.planes[p][0][i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(p, i)
            code, i = code << 1 | bit, self._zeros(p) + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """The places in the last order of the token's occurrences before i."""
        code = self.codes.get(token)
        if code is None:
            return 0, 0
        low, high = 0, i
        for p in range(len(self.planes)):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self._zeros(p) + a, self._zeros(p) + b) if code >> (len(self.planes) - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's occurrence k, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i, code = low + k, self.codes[token]
        for p in reversed(range(len(self.planes))):
            bit = code >> (len(self.planes) - 1 - p) & 1
            want, (left, right) = i - (self._zeros(p) if bit else 0), (0, self.n)
            while left < right:  # the place before which want bits of this kind stand
                mid = (left + right + 1) // 2
                ones = self._ones(p, mid)
                left, right = (mid, right) if (ones if bit else mid - ones) <= want else (left, mid - 1)
            i = left
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last order back to the first."""
        code = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for b, (bits, _) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(bits, count=self.n).view(bool)
            before, zero, one = np.empty_like(code), 0, self.n - int(np.count_nonzero(bit))
            for at in spans(self.n):
                zeros, ones = np.flatnonzero(~bit[at]), np.flatnonzero(bit[at])
                before[at][zeros] = code[zero : zero + len(zeros)]
                before[at][ones] = code[one : one + len(ones)] | code.dtype.type(1 << b)
                zero, one = zero + len(zeros), one + len(ones)
            code = before
        return self.alphabet[code]

    def document(self, k: int) -> np.ndarray:
        return np.array([self.access(i) for i in range(self.offsets[k], self.offsets[k + 1])], np.uint32)


class Encoder:
    """Ids of texts. Where blanks and line feeds part a text for the loaded tokenizer, each distinct piece is encoded once; else whole texts are."""

    made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.past = Tokenizer.from_file(path), {"": b""}, {}
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        made = json.loads(self.tokenizer.to_str())
        self.by_piece = parts_at_blanks(made)
        self.special = [t["content"].lower() for t in made["added_tokens"]]
        # the same model behind blanks alone: for ASCII letters, which are their own bytes' letters, and for others
        blanks, letters = pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer, self.latin.pre_tokenizer = blanks, pre_tokenizers.Sequence([blanks, letters])
        # which ids end a word
        vocabulary, suffix = self.plain.get_vocab(), made["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def encoded(self, texts: list[str]):
        return (np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def words(self, words: list[str], tokenizer):
        """The ids, as bytes, of words of small Latin letters, which the splitter hands to the model as they are."""
        for some in (words[at : at + AT_ONCE] for at in range(0, len(words), AT_ONCE)):
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                data, to = ids.tobytes(), (ends * ids.itemsize).tolist()
                yield from (data[a:b] for a, b in zip([0, *to], to))
            else:  # a model that drops letters or does not mark ends
                yield from (x.tobytes() for x in self.encoded(some))

    def learn(self, words: set[str], whole: set[str]) -> None:
        """Makes words of small Latin letters known, and pieces that the tokenizer gets as they are."""
        known, past = self.known, self.past
        new = [x for x in words if x not in known]
        known |= {x: past[x] for x in new if x in past}
        plain, latin = ([x for x in new if x not in past and x.isascii() == a] for a in (True, False))
        known |= zip(plain, self.words(plain, self.plain))
        known |= zip(latin, self.words(latin, self.latin))
        rest = [x for x in whole if x not in known]
        known |= {x: past[x] for x in rest if x in past}
        rest = [x for x in rest if x not in past]
        known |= zip(rest, (x.tobytes() for x in self.encoded(rest)))

    def distinct(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each piece. Latin letters with ASCII marks behind are two, as the tokenizer splits there, in small letters; any other piece stays whole."""
        if len(self.known) > WORDS:
            self.past, self.known = self.known if len(self.known) < 4 * WORDS else {}, {"": b""}
        cores = pc.ascii_rtrim(pieces, MARKS)
        small = pc.match_substring_regex(cores, WORD).to_numpy(zero_copy_only=False)
        marked = pc.not_equal(pc.binary_length(cores), pc.binary_length(pieces)).to_numpy(zero_copy_only=False)
        heads, whole, marks = cores.to_numpy(zero_copy_only=False).tolist(), {}, {}
        other = np.flatnonzero(~small | marked)
        for k, p, of_small in zip(other.tolist(), pieces.take(pa.array(other)).to_numpy(zero_copy_only=False).tolist(), small[other].tolist(), strict=True):
            core = heads[k]
            if of_small or (core.isalpha() and max(core) < LATIN and FALLS_APART not in core):
                heads[k], marks[k] = core.lower(), p[len(core) :]
            else:
                heads[k] = whole[k] = p
        self.learn(set(heads).difference(whole.values()), {*whole.values(), *marks.values()})
        ids = list(map(self.known.__getitem__, heads))
        for k, x in marks.items():
            ids[k] += self.known[x]
        return ids

    def small(self, text: str) -> str:
        """A text with blanks for line feeds; one of Latin-1 in small letters, unless a special token could come or go with that."""
        try:
            small = text.encode("latin-1").translate(SMALL).decode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ")
        return text.replace("\n", " ") if any(t in small for t in self.special) else small

    def all(self, texts: list[str | None]):
        """The ids of each text; pieces of all are held."""
        few = [t or "" for t in texts]
        if not self.by_piece:
            for at in range(0, len(few), TEXTS):
                yield from self.encoded(few[at : at + TEXTS])
            return
        pieces = pc.split_pattern(pa.array(map(self.small, few), pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        ids = self.distinct(coded.dictionary)
        ends, index = np.cumsum([len(x) for x in ids], dtype=np.int64) // np.dtype(self.kind).itemsize, coded.indices.to_numpy()
        lengths = np.diff(ends, prepend=0)[index]
        to = np.concatenate(([0], np.cumsum(lengths)))
        found = np.frombuffer(b"".join(ids), self.kind)[np.arange(to[-1]) + np.repeat(ends[index] - to[1:], lengths)]
        cuts = to[pieces.offsets.to_numpy()].tolist()
        yield from (found[a:b] for a, b in zip(cuts, cuts[1:]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_FILE = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the files of docs (doc_id, text) below path; (part, file) gives their order. tokenizer: a file's path on every machine."""

    def encode(batches):
        from pyspark import TaskContext

        part, file, held, size, encoder = TaskContext.get().partitionId(), 0, [], 0, None

        def flush():
            ids = np.concatenate([x for _, x in held])
            data = write_file(ids, np.array([d for d, _ in held], np.int64), np.array([len(x) for _, x in held], np.int64))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, file, len(ids), len(held), data), _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            encoder = encoder or Encoder.of(tokenizer or default_tokenizer())
            end = np.array([end_id], encoder.kind)
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BYTES)) + 1).tolist(), batch.num_rows]
            for few in (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
                for doc_id, ids in zip(few.column(0).to_pylist(), encoder.all(texts(few)), strict=True):
                    held.append((doc_id, np.concatenate((ids, end))))
                    size += len(held[-1][1])
                    if size >= shard_tokens:
                        yield flush()
                        file, held, size = file + 1, [], 0
        if held:
            yield flush()

    spark = docs.sparkSession
    # equal doc_ids, and null ones, are dealt by how their texts begin
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").withColumn("_begin", F.substring("text", 1, BEGIN))
    ordered = rows.repartitionByRange(parts(spark), "doc_id", "_begin").sortWithinPartitions("doc_id", "text").drop("_begin")
    ordered.mapInArrow(encode, "part int, file int, n_ids long, n_docs long, data binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files below path."""

    def decode(batches):
        for batch in batches:
            for part, file, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                found = TokenFile(data.as_buffer().to_pybytes())
                ids = found.ids().astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(found.offsets, found.offsets[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([file.as_py()] * n, pa.int32()), pa.array(found.doc_ids), pa.array(found.offsets[:-1]), pa.array(found.lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "file", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema("part int, file int, n_ids long, n_docs long, data binary").parquet(path)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "file", "n_ids").withColumn("before", before).drop("n_ids")
    docs = files.select("part", "file", "data").mapInArrow(decode, "part int, file int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "file"]).select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and returns read_documents() of them."""
    path = scratch(docs.sparkSession)
    write_token_files(docs, path, tokenizer)
    return read_documents(docs.sparkSession, path)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
