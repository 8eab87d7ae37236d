"""Full-text search as a relation: a positional index, a query language, rank and snippets.

The index is a stored table of blocks (token, field, ids, places): the postings of one token in many documents, so that a token is written,
shuffled and sorted once a block, not once a posting. Blocks are dealt to files in ranges of token of like numbers of bytes and sorted by it, so the files'
statistics prune a token's scan; read as postings (id, field, pos, token) they are taken apart after the scan. An index that few searches ask
(``dealt=False``) keeps its blocks where their texts were read, in runs sorted by token: nothing of it is shuffled, and a scan passes over pages of other tokens. A change adds a layer: the postings of its rows, and the ids whose older postings no longer count. A query
compiles to semi-, anti- and inner joins on it: words side by side must all occur, ``OR``, ``NOT``, ``"a phrase"``, ``prefix*`` and
``NEAR/n`` combine. A match may lie in any field.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.plans import relation as R
from relspan.plans.delta import Change
from relspan.plans.relation import Relation, quoted
from relspan.sources.scratch import discard, staged, staged_counted, stored_bytes
from relspan.sources.shipping import ship

TOKEN = r"[\p{L}\p{M}\p{N}]+"
BEGIN, END, ELLIPSIS = "\x02", "\x03", "\x04"
WINDOW = 15
#: Bytes of postings from which they are dealt to files by token.
CLUSTERED = 64 << 20
#: Bytes of postings in one of these files.
FILE = 32 << 20
#: Blocks that are looked at for each of these files, to find ranges of token with even numbers of bytes.
LOOKED_AT = 64
#: Postings in a block at most, and tokens that a task groups to blocks at once.
BLOCK, GROUPED = 4096, 4_000_000
#: Of lists, differences are written: ids and places rise within a block, and a dictionary of them would not hold.
DIFFERENCES = {"parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false", "parquet.enable.dictionary#places.list.element": "false"}
#: Bytes of an Arrow batch of texts or their tokens; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Layers of changes after which the index is written anew.
LAYERS = 16


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; the last one may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class But:
    left: object
    right: object


@dataclass(frozen=True)
class Near:
    left: Phrase
    right: Phrase
    distance: int


_LEX = re.compile(r'"([^"]*)"|(\()|(\))|\b(AND|OR|NOT)\b|\bNEAR(?:/(\d+))?\b|([^\s()"]+)')


def _tokens(text: str) -> list[str]:
    import regex

    return regex.findall(TOKEN, text.lower())


def parse(query: str) -> object:
    """The query's tree, or None for one with no terms. NOT binds to the left, OR loosest."""
    items: list[tuple[str, object]] = []
    for m in _LEX.finditer(query):
        if m[1] is not None or m[6] is not None:
            raw = m[1] if m[1] is not None else m[6]
            t = _tokens(raw)
            if t:
                items.append(("phrase", Phrase(tuple(t), raw.rstrip().endswith("*"))))
        elif m[2] or m[3]:
            items.append((m[2] or m[3], None))
        elif m[4]:
            items.append((m[4], None))
        else:
            items.append(("NEAR", int(m[5] or 10)))
    at = 0

    def peek() -> str:
        return items[at][0] if at < len(items) else ""

    def either() -> object:
        nonlocal at
        left = every()
        while peek() == "OR":
            at += 1
            left = Either(left, every())
        return left

    def every() -> object:
        nonlocal at
        left = term()
        while peek() not in ("", ")", "OR"):
            if peek() == "NOT":
                at += 1
                left = But(left, term())
            elif peek() == "NEAR":
                n = items[at][1]
                at += 1
                left = Near(left, term(), n)
            else:
                at += peek() == "AND"
                left = Both(left, term())
        return left

    def term() -> object:
        nonlocal at
        kind, value = items[at] if at < len(items) else ("", None)
        at += 1
        if kind == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"no closing parenthesis in {query!r}")
            at += 1
            return inner
        if kind != "phrase":
            raise ValueError(f"a term is missing in {query!r}")
        return value

    if not items:
        return None
    tree = either()
    if at < len(items):
        raise ValueError(f"cannot read all of {query!r}")
    return tree


def phrases_of(tree: object) -> list[Phrase]:
    """Phrases that count for rank and snippets: all but those under NOT."""
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, But):
        return phrases_of(tree.left)
    return [*phrases_of(tree.left), *phrases_of(tree.right)] if tree is not None else []


def _python_ready(spark: SparkSession) -> None:
    """Before Python on the executors: send them this package, and bound Arrow batches by bytes, as texts are long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_WORD = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
#: Of characters in two bytes, the second after 0xC2 and 0xC3: letters and numbers; capitals.
_AFTER_C2 = np.isin(np.arange(256), [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])
_AFTER_C3 = ~np.isin(np.arange(256), [0x97, 0xB7])
_CAPITAL = _AFTER_C3 & (np.arange(256) <= 0x9E)


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """The tokens of each text, in order and in lower case; null has none. Texts of Latin-1 and common punctuation (U+2000 to U+206F, the euro sign) are split by
    array operations over their bytes, others one by one."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw else np.zeros(0, np.uint8)
    at = at - at[0]
    low, inside = _LOWER[data], _WORD[data]
    high = np.flatnonzero(data >= 0x80)
    others = np.zeros(0, np.int64)
    if len(high):
        ahead = np.append(data, [0, 0])
        first, second, third = ahead[high], ahead[high + 1], ahead[high + 2]
        two = ((first == 0xC2) | (first == 0xC3)) & (second >> 6 == 2)
        three = (first == 0xE2) & (((second == 0x80) & (third >> 6 == 2)) | ((second == 0x81) & (third >> 6 == 2) & (third <= 0xAF)) | ((second == 0x82) & (third == 0xAC)))
        known = two | three
        known[1:] |= two[:-1] | three[:-1]
        known[2:] |= three[:-2]
        torn = at[:-1][ahead[at[:-1]] >> 6 == 2]  # no text begins within a character
        bad = np.concatenate([high[~known], torn, torn[torn > 0] - 1])
        others = np.unique(np.searchsorted(at, bad, "right") - 1)
        word = high[two & np.where(first == 0xC3, _AFTER_C3[second], _AFTER_C2[second])]
        inside[word] = inside[word + 1] = True
        low[high[two & (first == 0xC3) & _CAPITAL[second]] + 1] += 0x20
        for k in others:
            inside[at[k] : at[k + 1]] = False
    cut = np.zeros(len(data) + 1, bool)  # a text ends where the next begins
    cut[at] = True
    begin, end = inside & cut[:-1], inside & cut[1:]
    begin[1:] |= inside[1:] & ~inside[:-1]
    end[:-1] |= inside[:-1] & ~inside[1:]
    start = np.flatnonzero(begin)
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(np.flatnonzero(end) + 1 - start, out=ends[1:])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(low[inside]))
    found = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, at), pa.int32()), words)
    if not len(others):
        return found
    own: list[list[str] | None] = [None] * len(texts)
    for k in others:
        own[k] = _tokens(data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
    return pc.coalesce(pa.array(own, found.type), found)


def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, field, text): (id, field, w), w the tokens in order."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("field"), tokens_of(b.column("text"))], ["id", "field", "w"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, field, w), w the tokens in order: (token, field, ids, places), sorted within about GROUPED tokens."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += pc.sum(pc.list_value_length(b.column("w"))).as_py() or 0
        if n >= GROUPED:
            yield from _grouped(held)
            held, n = [], 0
    if n:
        yield from _grouped(held)


def _grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = np.concatenate([pc.fill_null(pc.list_value_length(b.column("w")), 0).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
    words = pa.concat_arrays([b.column("w").flatten() for b in held]).dictionary_encode()
    fields = pa.concat_arrays([b.column("field") for b in held]).dictionary_encode()
    ids = pa.concat_arrays([b.column("id") for b in held])
    doc = np.repeat(np.arange(len(many), dtype=np.int32), many)
    pos = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(many) - many).astype(np.int32), many)
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    wide, shift = len(fields.dictionary), len(doc).bit_length()
    key = rank[words.indices.to_numpy()].astype(np.int64)
    key *= wide
    key += fields.indices.to_numpy()[doc]
    key <<= shift
    key |= np.arange(len(key), dtype=np.int32)
    key.sort()  # by token and field, then in order
    by = (key & ((1 << shift) - 1)).astype(np.int32)
    key >>= shift
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    pieces = -(-np.diff(np.append(first, len(key))) // BLOCK)  # blocks of a list
    cuts = np.repeat(first, pieces) + BLOCK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    for lo in range(0, len(cuts), 65536):  # a batch out
        some = cuts[lo : lo + 65536]
        end = cuts[lo + 65536] if lo + 65536 < len(cuts) else len(key)
        own, offsets = by[some[0] : end], pa.array(np.append(some, end) - some[0], pa.int32())
        yield pa.RecordBatch.from_arrays([
            words.dictionary.take(pa.array(order[key[some] // wide])), fields.dictionary.take(pa.array(key[some] % wide)),
            pa.ListArray.from_arrays(offsets, ids.take(pa.array(doc[own]))), pa.ListArray.from_arrays(offsets, pa.array(pos[own])),
        ], ["token", "field", "ids", "places"])


def ends(flat: DataFrame, parts: int) -> list[Column]:
    """Keys (token, first id) at which blocks are cut into at most ``parts`` ranges of like numbers of bytes. Blocks of frequent tokens are long and lie
    together, so ranges of like numbers of blocks would differ by far. About LOOKED_AT blocks a range are looked at, each the likelier the longer it is."""
    size = F.col("n") * 12 + 96  # of a shuffled row, about
    rate = parts * LOOKED_AT / max(1, flat.agg(F.sum(size)).first()[0] or 0)
    key = F.struct("token", "first")
    seen = [r.key for r in flat.where(F.rand(0) < size * rate).select(key.alias("key")).sort("key").collect()]
    kinds = [flat.schema[c].dataType for c in ("token", "first")]
    cuts = dict.fromkeys(seen[len(seen) * k // parts] for k in range(1, parts)) if seen else ()
    return [F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, kinds, ("token", "first")))) for cut in cuts]


def _part(cuts: list[Column]) -> Column:
    """The number of cuts that aren't above a block's key, by halving."""
    key = F.struct("token", "first")

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(cuts))


def _apart(stored: DataFrame) -> DataFrame:
    """Blocks as postings (id, field, pos, token)."""
    return stored.select("token", "field", F.inline(F.arrays_zip("ids", "places"))).select(F.col("ids").alias("id"), "field", F.col("places").alias("pos"), "token")


@dataclass
class _Layer:
    """Texts and postings of rows, and the ids that older layers no longer speak for."""

    texts: DataFrame
    postings: DataFrame
    gone: DataFrame | None = None


class TextIndex:
    """An index over text fields of a relation. ``refresh`` takes a change of the relation; only its rows are tokenized and written.
    dealt: blocks are dealt to files by token, which costs more than a few searches save."""

    def __init__(self, content: Relation, ident: str, fields: dict[str, Column | str] | list[str], dealt: bool = True) -> None:
        self.content, self.ident, self.dealt = content, ident, dealt
        self.fields = {f: quoted(f) for f in fields} if isinstance(fields, list) else {k: quoted(c) if isinstance(c, str) else c for k, c in fields.items()}
        texts = self._texts(content.df())
        self.layers = [_Layer(texts, self._indexed(texts))]
        self.searches: list[Search] = []

    def _texts(self, rows: DataFrame) -> DataFrame:
        def clean(c: Column) -> Column:
            text = F.coalesce(c.cast("string"), F.lit(""))
            marked = F.contains(text, F.lit(BEGIN)) | F.contains(text, F.lit(END)) | F.contains(text, F.lit(ELLIPSIS))  # so few texts are replaced
            return F.when(marked, F.regexp_replace(text, f"[{BEGIN}{END}{ELLIPSIS}]", "")).otherwise(text)

        return rows.select(quoted(self.ident).alias("id"), *(clean(c).alias(f) for f, c in self.fields.items()))

    def _post(self, texts: DataFrame) -> DataFrame:
        """Blocks of postings."""
        _python_ready(texts.sparkSession)
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), quoted(f).alias("text")) for f in self.fields))).alias("x")
        flat = texts.select("id", each).select("id", "x.field", "x.text")
        kinds = {"token": T.StringType(), "field": T.StringType(), "ids": T.ArrayType(texts.schema["id"].dataType), "places": T.ArrayType(T.IntegerType())}
        return flat.mapInArrow(lambda batches: blocks(worded(batches)), T.StructType([T.StructField(n, k) for n, k in kinds.items()]))

    def _indexed(self, texts: DataFrame) -> DataFrame:
        found = self._post(texts)
        return self._stored(found) if self.dealt else _apart(staged(found, "postings", **DIFFERENCES))

    @staticmethod
    def _stored(found: DataFrame) -> DataFrame:
        """In ranges of token. The ranges come from what is written first, so that texts are tokenized once; what takes less than CLUSTERED bytes
        stays as it is, as a scan of it is as quick."""
        flat = staged(found.withColumns({"first": F.element_at("ids", 1), "n": F.size("ids")}), "postings-flat")
        out, n_bytes = flat, stored_bytes(flat)
        if n_bytes >= CLUSTERED:
            parts = max(1, flat.rdd.getNumPartitions(), -(-n_bytes // FILE))
            ranged = flat.repartitionById(parts, _part(ends(flat, parts))) if parts > 1 else flat
            out = staged(ranged.sortWithinPartitions("token", "first").drop("first", "n"), "postings")
            discard(flat.sparkSession, flat)
        return _apart(out)

    def _composed(self, which: str) -> DataFrame:
        out = getattr(self.layers[0], which)
        for layer in self.layers[1:]:
            out = R.null_safe(out, layer.gone, [("id", "id")], "left_anti").unionByName(getattr(layer, which))
        return out

    @property
    def texts(self) -> DataFrame:
        return self._composed("texts")

    @property
    def postings(self) -> DataFrame:
        return self._composed("postings")

    def refresh(self, added: DataFrame | None, removed: DataFrame | None) -> None:
        """Take a change of the content, as one more layer; live searches see it at their next read, and tell their observers now."""
        some = [x for x in (removed, added) if x is not None]
        if not some:
            return
        before = [s.df() if s.observers else None for s in self.searches]
        ids = some[0].select(quoted(self.ident).alias("id"))
        for x in some[1:]:
            ids = ids.unionByName(x.select(quoted(self.ident).alias("id")))
        fresh = staged(self._texts(added if added is not None else removed.limit(0)), "texts")
        self.layers.append(_Layer(fresh, self._indexed(fresh), staged(ids.distinct(), "gone")))
        if len(self.layers) > LAYERS:
            texts = staged(self.texts, "texts")
            self.layers = [_Layer(texts, self._indexed(texts))]
        for s, old in zip(self.searches, before):
            if old is not None:
                s.changed(old)

    # matching

    def hits(self, p: Phrase) -> DataFrame:
        """(id, field, pos) where a phrase begins: lists of its tokens, shifted, joined."""
        out = None
        for k, token in enumerate(p.tokens):
            last = p.prefix and k == len(p.tokens) - 1
            test = F.col("token").startswith(token) if last else F.col("token") == token
            own = self.postings.where(test).select("id", "field", (F.col("pos") - k).alias("pos"))
            out = own if out is None else out.join(own, ["id", "field", "pos"], "left_semi")
        return out

    def matching(self, tree: object) -> DataFrame:
        """(id) of what a query matches."""
        match tree:
            case None:
                return self.texts.select("id").limit(0)
            case Phrase():
                return self.hits(tree).select("id").distinct()
            case Both(a, b):
                return self.matching(a).join(self.matching(b), "id", "left_semi")
            case Either(a, b):
                return self.matching(a).unionByName(self.matching(b)).distinct()
            case But(a, b):
                return self.matching(a).join(self.matching(b), "id", "left_anti")
            case Near(a, b, n):
                # bands as wide as two beginnings can lie apart: one band of the left side, three of the right
                wide = n + max(len(a.tokens), len(b.tokens)) + 1
                # both are dealt by key: the lists of frequent tokens lie in few files, and a task would go on with what one scan has made
                key = ["id", "field", "band"]
                x = self.hits(a).withColumn("band", F.floor(F.col("pos") / wide)).repartition(*key)
                y = self.hits(b).withColumnRenamed("pos", "other").withColumn("band", F.explode(F.array(*(F.floor(F.col("other") / wide) + k for k in (-1, 0, 1))))).repartition(*key)
                ends = F.when(F.col("other") > F.col("pos"), F.col("other") - F.col("pos") - len(a.tokens)).otherwise(F.col("pos") - F.col("other") - len(b.tokens))
                return x.join(y, key).where(ends.between(0, n)).select("id").distinct()
        raise TypeError(tree)

    def rank(self, tree: object) -> DataFrame:
        """(id, rank): over phrases and fields, the hits in the row by the hits in all rows; a phrase with none adds 0."""
        found = self.matching(tree)
        parts = None
        for p in dict.fromkeys(phrases_of(tree)):
            own = self.hits(p).groupBy("id", "field").agg(F.count("*").alias("n"))
            total = own.groupBy("field").agg(F.sum("n").alias("all"))
            one = own.join(F.broadcast(total), "field").select("id", (F.col("n") / F.col("all")).alias("part"))  # a row a field
            parts = one if parts is None else parts.unionByName(one)
        if parts is None:
            return found.withColumn("rank", F.lit(0.0))
        return found.join(parts.groupBy("id").agg(F.sum("part").alias("rank")), "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("rank"))

    def search(self, query: str) -> Search:
        self.searches.append(Search(self, query))
        return self.searches[-1]


class Search:
    """A live search. Rows: the id attribute, rank, and a snippet of each field. Setting ``query`` tells the observers what has come and gone."""

    def __init__(self, index: TextIndex, query: str) -> None:
        self.index, self._query = index, query
        self.observers: list[Callable[[Change], None]] = []

    @property
    def query(self) -> str:
        return self._query

    @query.setter
    def query(self, query: str) -> None:
        parse(query)
        old = self.df() if self.observers else None
        self._query = query
        if old is not None:
            self.changed(old)

    def observe(self, call: Callable[[Change], None]) -> Callable[[], None]:
        """call(change) after the query has been set or the index refreshed, if rows came or went; returns what ends it."""
        self.observers.append(call)
        return lambda: self.observers.remove(call)

    def changed(self, old: DataFrame) -> None:
        old, now = staged(old, "before"), staged(self.df(), "after")  # each is read twice
        change = Change(staged(R.minus(now, old), "found"), staged(R.minus(old, now), "lost"))
        discard(now.sparkSession, old, now)
        if not change.is_empty():
            for call in list(self.observers):
                call(change)

    def df(self) -> DataFrame:
        tree = parse(self.query)
        ranks, n = staged_counted(self.index.rank(tree), "ranks")  # counted, so that few need no shuffle of the texts
        ranked = self.index.texts.join(F.broadcast(ranks) if n <= R.SMALL else ranks, "id").select("id", "rank", *map(quoted, self.index.fields))
        wanted = [(p.tokens, p.prefix) for p in phrases_of(tree)]
        fields = list(self.index.fields)

        def snippets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for f in fields:
                    pdf[f] = [snippet(x, wanted) for x in pdf[f]]
                yield pdf

        _python_ready(ranked.sparkSession)
        out = ranked.mapInPandas(snippets, ranked.schema)
        return out.select(F.col("id").alias(self.index.ident), "rank", *(quoted(f).alias(f"{f}_snippet") for f in fields))

    def relation(self) -> Relation:
        return R.Leaf(self.df(), keys=[[self.index.ident]])


def snippet(text: str, wanted: list[tuple[tuple[str, ...], bool]], window: int = WINDOW) -> str:
    """The WINDOW tokens with the most hits, hits between BEGIN and END, ELLIPSIS where text is left out."""
    import regex

    spans = [m.span() for m in regex.finditer(TOKEN, text)]
    tokens = [text[a:b].lower() for a, b in spans]
    marked: dict[int, int] = {}
    for want, prefix in wanted:
        n, last = len(want), want[-1]
        for k in [k for k, t in enumerate(tokens) if t.startswith(last)] if prefix else [k for k, t in enumerate(tokens) if t == last]:
            if k >= n - 1 and (n == 1 or tuple(tokens[k - n + 1 : k]) == want[:-1]):
                marked[k - n + 1] = max(marked.get(k - n + 1, 0), n)
    if not spans:
        return text
    best, at = -1, 0
    starts, places = sorted({0, *(max(0, k - window // 3) for k in marked)}), sorted(marked)
    for s in starts:
        s = max(0, min(s, len(tokens) - window))
        n = bisect_left(places, s + window) - bisect_left(places, s)
        if n > best:
            best, at = n, s
    end = min(len(tokens), at + window)
    lo, hi = (0 if at == 0 else spans[at][0]), (len(text) if end == len(tokens) else spans[end - 1][1])
    out, pos = [ELLIPSIS] if at else [], lo
    k = at
    while k < end:
        if k in marked:
            last = min(k + marked[k], end) - 1
            out += [text[pos : spans[k][0]], BEGIN, text[spans[k][0] : spans[last][1]], END]
            pos, k = spans[last][1], last + 1
        else:
            k += 1
    out.append(text[pos:hi])
    return "".join(out) + (ELLIPSIS if end < len(tokens) else "")


@dataclass(frozen=True)
class StructuredSnippet:
    ellipsis_at_start: bool
    ellipsis_at_end: bool
    text: str
    matches: tuple[tuple[int, int], ...]

    @classmethod
    def parse(cls, raw: str) -> StructuredSnippet:
        """Split a raw snippet into its text and the ranges of its hits."""
        start, end = raw.startswith(ELLIPSIS), raw.endswith(ELLIPSIS)
        text, matches, begun = "", [], None
        for c in raw.strip(ELLIPSIS):
            if c == BEGIN:
                begun = len(text)
            elif c == END and begun is not None:
                matches.append((begun, len(text)))
                begun = None
            elif c not in (BEGIN, END, ELLIPSIS):
                text += c
        return cls(start, end, text, tuple(matches))
