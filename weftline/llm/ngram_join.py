"""Operator 8, n-gram Jaccard join: signature trees.

A document's set is its distinct shingles of ``width`` lower-cased words, as 64-bit hashes; two documents link when
100 * overlap >= ``percent`` * union. The result is the component of every document, not all pairs of a group of
copies; no link between different sets is lost.

1. Documents with equal sets form a class, found by a 128-bit digest of the set; only one row of a class goes on. The
   row's own key (block and place) is the class's node, so no step depends on ids.
2. Prefix filter: two linked sets of sizes n and m have at least ceil(percent * n / 100) tokens in common, so the
   first n - ceil(percent * n / 100) + k tokens of each, in one fixed order of all tokens, have k tokens in common.
   The order puts frequent tokens last; k is an eighth of the set. Sets whose prefix shares fewer tokens with all
   others together have no link; of the others only the tokens by which a partner must be met are kept.
3. Sets that are left meet by their first shared token, at most ``GROUP`` at a time; a signature tree with dual
   traversal finds links, verified on the sets, and passes over node pairs whose sets are linked already. Sets that
   stand for a group meet once more.
4. What is left: a shared token whose sets are all linked, or have all met, is done with; so a large group of near
   copies gathers nowhere. Every other token's group goes through a signature tree of bitmaps alone; pairs that have not met and
   that the bound cannot rule out join areas of doubt. The sets of each area are fetched and compared as in step 3; an
   area of more than ``GROUP`` sets is cut in chunks, and each pair of chunks is compared.
5. Components of the verified links and of classes that share an id, by alternating stars.

Steps 1 and 2 exchange packed arrays between blocks (``blocks``), so a token or a copy that a third of all documents
share costs one entry a block.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer than ``width`` words
make one shingle of the whole sequence; rows with equal ids are one document of the component, each with its own size;
a null id stands after all others, and rows with null ids are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks as B
from weftline.llm.hashing import Tokens, member, mix
from weftline.llm.signature_tree import UnionFind, bitmap, bits_for, link_candidates, link_sets
from weftline.operators.components import connected_components
from weftline.session import checkpointed

WIDTH, PERCENT = 5, 75
GROUP = 1000
HOT_TOKENS = 1 << 16  # the order of tokens knows so many frequent ones; the order changes cost, never results
HOT_LEAST = 32
AT_ONCE = 1 << 20  # bytes of text whose shingles are hashed at once
CLASS_TYPES = (np.uint64, np.uint64, np.int64, np.int64)  # digest, least id, least node
DOCUMENTS = "doc_id long, n long, class_id long, node long, text binary, shared binary"


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; some documents at a time bound the memory."""
    out, at = [], 0
    while at + 1 < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + AT_ONCE, side="right")) - 1)
        out += _sets(data[starts[at] : starts[to]], starts[at : to + 1] - starts[at], width)
        at = to
    return out


def _sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    tokens = Tokens(data, starts, lower=True)
    hashes, whole = tokens.windows(width)
    keys, doc = hashes[whole], tokens.doc[whole]
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    out = np.split(keys, np.searchsorted(doc, np.arange(1, len(starts) - 1)))
    for k in np.flatnonzero((tokens.counts > 0) & (tokens.counts < width)):
        value = np.array([tokens.counts[k]], np.uint64)
        for h in tokens.hashes[tokens.first[k] : tokens.first[k + 1]]:
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h)
        out[k] = value
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: a sum and an exclusive or of mixed tokens."""
    return int(np.add.reduce(mix(s + np.uint64(len(s))))), int(np.bitwise_xor.reduce(mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))))


def _node(block: int, k: int) -> int:
    """A key of its own for each row, of its block (partition, place in it) and its place in the block."""
    partition, seq = block >> 32, block & 0xFFFFFFFF
    if partition >> 20 or seq >> 20 or k >> 23:
        raise OverflowError(f"no key for row {k} of block {block}")
    return partition << 43 | seq << 23 | k


def _common(n: int) -> int:
    """So many tokens at least are common to the prefixes of two linked sets of ``n`` tokens or more."""
    return 1 + n // 8


def _prefix_size(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + _common(n))


def _kept(shared: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The shared tokens of a prefix by which a set must be met; none, if too few are shared for any link.

    A partner has ceil(percent * n / 100) tokens at least, so ``least`` tokens or more are common to both prefixes. The
    first of them still has ``least - 1`` behind it, so as many may be left off at the end."""
    least = _common(-(-percent * n // 100))
    return shared[: max(0, len(shared) - least + 1)]


def _prefix(s: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a set: those that are not hot by value, then hot ones by rank."""
    n = _prefix_size(len(s), percent)
    warm = member(s, hot)
    cold = s[~warm]
    if len(cold) >= n:
        return cold[:n]
    late = s[warm]
    late = late[np.argsort(rank[np.searchsorted(hot, late)], kind="stable")]
    return np.concatenate([cold, late])[:n]


def _frequent(blocks: DataFrame, parts: int, width: int) -> DataFrame:
    """(hot, times): tokens that some block holds three times or more, with their counts over such blocks."""

    def send(block, payload):
        _, starts, data = B.unpack(payload)
        everything = np.sort(np.concatenate(shingle_sets(data, starts, width)))
        start = np.flatnonzero(np.concatenate([[True], everything[1:] != everything[:-1]])) if len(everything) else np.zeros(0, np.int64)
        counts = np.diff(np.append(start, len(everything)))
        tokens, counts = everything[start][counts >= 3], counts[counts >= 3]
        order, cuts = B.split_by_part(tokens, parts)
        for p in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[p] : cuts[p + 1]]
            yield int(p), block, B.planes(tokens[own]) + B.planes(counts[own].astype(np.uint64))

    def add(part, froms, payloads):
        tokens, times = (np.concatenate([B.from_planes(x[: len(x) // 2] if k == 0 else x[len(x) // 2 :]) for x in payloads]) for k in (0, 1))
        values, at = np.unique(tokens, return_inverse=True)
        total = np.bincount(at, times.astype(float)).astype(np.int64)
        keep = np.flatnonzero(total >= HOT_LEAST)
        keep = keep[np.argsort(-total[keep], kind="stable")][:HOT_TOKENS]
        yield values[keep].tobytes(), total[keep].tobytes()

    return B.each_part(B.each_block(blocks, send, B.SENT_SCHEMA), add, "hot binary, times binary")


def _hot_tokens(hot: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``HOT_TOKENS`` most frequent tokens, sorted by value, with their ranks: least frequent first."""
    tokens, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for row in hot.toLocalIterator():
        tokens = np.concatenate([tokens, np.frombuffer(row[0], np.uint64)])
        times = np.concatenate([times, np.frombuffer(row[1], np.int64)])
        keep = np.lexsort((tokens, -times))[:HOT_TOKENS]
        tokens, times = tokens[keep], times[keep]
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, times))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def _sets_of(pressed: list[bytes], width: int) -> list[np.ndarray]:
    """Sets of texts on the way: hashing shingles again where a text arrives takes a third of the bytes of hashes."""
    out, texts, size = [], [], 0
    for k, x in enumerate(pressed):
        texts.append(B.unpress(x))
        size += len(texts[-1])
        if size >= AT_ONCE or k + 1 == len(pressed):
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            out += shingle_sets(np.frombuffer(b"".join(texts), np.uint8), starts, width)
            texts, size = [], 0
    return out


def _groups(rows: DataFrame, percent: int, width: int, group: int, parts: int) -> DataFrame:
    """(node, root, met) after linking the sets of ``rows`` (node, meet, text) that meet, ``group`` at a time. All
    pairs with one ``met`` have been compared."""
    large = rows.groupBy("meet").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group)
    salt = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(17)), F.ceil(F.col("_n") / group)))
    salted = rows.join(large, "meet", "left").withColumn("_salt", salt).select("node", "meet", "_salt", "text", F.xxhash64("meet", "_salt").alias("met")).withColumn("part", F.pmod("met", F.lit(parts)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, met), own in frame.groupby(["meet", "_salt", "met"], sort=False):
            own = own.sort_values("node", kind="stable")
            ids = own["node"].to_numpy()
            if len(ids) == 1:
                out.append(pd.DataFrame({"node": ids, "root": ids, "met": met}))
                continue
            links = link_sets(_sets_of(own["text"].tolist(), width), percent)
            out.append(pd.DataFrame({"node": ids, "root": ids[[links.find(k) for k in range(len(ids))]], "met": met}))
        B.give_back()
        return pd.concat(out)

    return salted.groupBy("part").applyInPandas(run, "node long, root long, met long")


def _classes_of(ids, nodes, sets, given):
    """The class of each set: the least id with the same set and the class's node; an empty set is a class of its own."""
    found = {}
    for raw in given:
        n = len(raw) // 32
        high, low, least, node = (np.frombuffer(raw, d, n, 8 * n * i).tolist() for i, d in enumerate(CLASS_TYPES))
        found.update(zip(zip(high, low, strict=True), zip(least, node, strict=True), strict=True))
    return [found[_digest(s)] if len(s) else (i, node) for i, node, s in zip(ids, nodes, sets, strict=True)]


def _meet(blocks: DataFrame, width: int, percent: int, parts: int, wide: int, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Every document with its set's size, class and the class's node; with text and shared prefix tokens, if it stands
    for its class and its prefix shares a token."""
    flag = np.uint64(1 << (64 - 8 * wide))

    def send(block, payload):
        ids, starts, data = B.unpack(payload)
        least: dict[tuple[int, int], int] = {}
        nodes, prefixes = [], []
        for k, (doc_id, s) in enumerate(zip(ids.tolist(), shingle_sets(data, starts, width), strict=True)):
            if len(s):
                key = _digest(s)
                if key not in least:
                    nodes.append(_node(block, k))
                    prefixes.append(_prefix(s, hot, rank, percent))
                least[key] = min(least.get(key, doc_id), doc_id)
        if not least:
            return
        high, low = (np.array([k[i] for k in least], np.uint64) for i in (0, 1))
        own, nodes = np.array(list(least.values()), np.int64), np.array(nodes, np.int64)
        order, cuts = B.split_by_part(high, parts)
        found, counts = np.unique(np.concatenate(prefixes) // flag | np.uint64(1), return_counts=True)
        found = (found ^ (counts > 1).astype(np.uint64)) * flag  # an even value: more than once in this block
        token_order, token_cuts = B.split_by_part(found, parts)
        for p in range(parts):
            k, t = order[cuts[p] : cuts[p + 1]], token_order[token_cuts[p] : token_cuts[p + 1]]
            if len(k) or len(t):
                yield p, block, np.int64(len(k)).tobytes() + high[k].tobytes() + low[k].tobytes() + own[k].tobytes() + nodes[k].tobytes() + B.planes(found[t], wide)

    def answer(part, froms, payloads):
        sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in payloads]
        digests = [tuple(np.frombuffer(x, d, n, 8 + 8 * n * i) for i, d in enumerate(CLASS_TYPES)) for x, n in zip(payloads, sizes, strict=True)]
        least: dict[tuple[int, int], tuple[int, int]] = {}
        for high, low, ids, nodes in digests:
            for a, b, i, node in zip(high.tolist(), low.tolist(), ids.tolist(), nodes.tolist(), strict=True):
                before = least.get((a, b), (i, node))
                least[a, b] = min(before[0], i), min(before[1], node)
        tokens = [B.from_planes(x[8 + 32 * n :], wide) for x, n in zip(payloads, sizes, strict=True)]
        values = np.concatenate(tokens)
        keys = values | flag
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys), bool)
        same[1:] = keys[order][1:] == keys[order][:-1]
        same[:-1] |= same[1:]
        shared = (values & flag) == 0
        shared[order[same]] = True
        at = 0
        for block, (high, low, _, _), own in zip(froms, digests, tokens, strict=True):
            back = keys[at : at + len(own)][shared[at : at + len(own)]]
            at += len(own)
            classes = np.array([least[k] for k in zip(high.tolist(), low.tolist(), strict=True)], np.int64).reshape(-1, 2).T
            yield block, np.int64(len(high)).tobytes() + high.tobytes() + low.tobytes() + classes.tobytes() + B.planes(back, wide)

    def documents(block, payload, given):
        ids, starts, data = B.unpack(payload)
        sets = shingle_sets(data, starts, width)
        sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in given]
        nodes = [_node(block, k) for k in range(len(ids))]
        classes = _classes_of(ids.tolist(), nodes, sets, [x[8 : 8 + 32 * n] for x, n in zip(given, sizes, strict=True)])
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(B.from_planes(x[8 + 32 * n :], wide) for x, n in zip(given, sizes, strict=True))]))
        raw = data.tobytes()
        for k, (i, s, (c, node)) in enumerate(zip(ids.tolist(), sets, classes, strict=True)):
            text = own = None
            if len(s) and nodes[k] == node:
                prefix = _prefix(s, hot, rank, percent)
                prefix = _kept(prefix[member((prefix // flag | np.uint64(1)) * flag, shared)], len(s), percent)
                if len(prefix):
                    text, own = B.press(raw[starts[k] : starts[k + 1]]), prefix.tobytes()
            yield i, len(s), c, node, text, own

    return B.each_answered(blocks, B.each_part(B.each_block(blocks, send, B.SENT_SCHEMA), answer), documents, DOCUMENTS)


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_bytes: int = B.BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set) and component_id of every document."""
    blocks = B.pack(docs, block_bytes)
    size = B.total_bytes(blocks)
    parts = B.part_count(size)
    hot, rank = _hot_tokens(_frequent(blocks, parts, width))
    every = checkpointed(_meet(blocks, width, percent, parts, B.key_bytes(size), hot, rank))
    left = every.where("text is not null").select("node", "n", "text", "shared")
    heavy = max(8, -(-left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8 // B.PART_BYTES))
    # the first shared token is the meeting place
    meeting = left.select("node", F.expr("substring(shared, 1, 8)").alias("meet"), "text")
    first = checkpointed(_groups(meeting, percent, width, group, heavy))
    again = checkpointed(_groups(meeting.join(first.where("node = root").select("node"), "node", "left_semi"), percent, width, group, heavy))
    roots = checkpointed(first.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", F.col("top").alias("root"), "met"))
    held = left.join(roots, "node")

    # a token whose sets are linked already, or have all been compared, has nothing to say
    tokens = held.select("node", "root", "met", F.explode(F.expr("transform(sequence(1, length(shared), 8), i -> substring(shared, i, 8))")).alias("token"))
    ends = [f(c).alias(f"_{c}{k}") for c in ("root", "met") for k, f in enumerate((F.min, F.max))]
    undecided = tokens.groupBy("token").agg(*ends).where("_root0 < _root1 and _met0 < _met1").select("token")
    asked = checkpointed(tokens.join(undecided, "token", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens")))

    def send_bitmaps(frames):
        for whole in frames:
            for frame in (whole.iloc[k : k + 500] for k in range(0, len(whole), 500)):
                rows = []
                for (node, n, own, root, met), s in zip(frame[["node", "n", "tokens", "root", "met"]].itertuples(index=False), _sets_of(frame["text"].tolist(), width), strict=True):
                    own = np.sort(np.frombuffer(b"".join(own), np.uint64))
                    raw = bitmap(s, bits_for(len(s))).tobytes()
                    to = (mix(own) % np.uint64(heavy)).astype(np.int64)
                    rows += [(int(p), node, n, root, met, raw, own[to == p].tobytes()) for p in np.unique(to)]
                yield pd.DataFrame(rows, columns=["part", "node", "n", "root", "met", "bits", "shared"])
        B.give_back()

    postings = held.join(asked, "node").mapInPandas(send_bitmaps, "part int, node long, n long, root long, met long, bits binary, shared binary")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = frame["node"].tolist(), frame["n"].to_numpy()
        maps = [np.frombuffer(x, np.uint64) for x in frame["bits"]]
        lists = [np.frombuffer(x, np.uint64) for x in frame["shared"]]
        links = UnionFind(len(ids))
        for column in ("root", "met"):  # linked, or compared already
            first_of: dict[int, int] = {}
            for k, value in enumerate(frame[column].tolist()):
                links.join(k, first_of.setdefault(value, k))
        tokens, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        pairs = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                pairs += link_candidates(maps, sizes, owner[a:b].tolist(), links, percent)
        B.give_back()
        return pd.DataFrame([(ids[x], ids[y]) for x, y in pairs], columns=["a", "b"], dtype="int64")

    doubtful = checkpointed(postings.groupBy("part").applyInPandas(compare, "a long, b long").distinct())
    # what may be linked through doubtful pairs, links and common meeting places is looked at once more as a whole
    stars = roots.join(roots.groupBy("met").agg(F.min("node").alias("_least")), "met").select(F.col("node").alias("a"), F.col("_least").alias("b"))
    areas = connected_components(doubtful.unionByName(stars).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    # an area of one root is linked already, an area of one meeting place has been compared
    whole = areas.join(roots, "node")
    open_ = whole.groupBy("component").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.min("met").alias("_m"), F.max("met").alias("_n")).where("_r < _s and _m < _n").select("component")
    again_ = checkpointed(areas.join(open_, "component", "left_semi"))
    sizes_ = again_.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / group).alias("_chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit(23)), F.col("_chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))
    placed = again_.join(sizes_, "component").withColumn("_c", chunk).withColumn("_o", other).select("node", "component", F.least("_c", "_o").alias("_x"), F.greatest("_c", "_o").alias("_y"))
    sent = placed.join(held.select("node", "text", "root"), "node").withColumn("part", F.pmod(F.xxhash64("component", "_x", "_y"), F.lit(heavy)).cast("int"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.groupby(["component", "_x", "_y"], sort=False):
            own = own.sort_values("node", kind="stable")
            ids, at = own["node"].tolist(), {}
            known = [at.setdefault(r, k) for k, r in enumerate(own["root"].tolist())]
            links = link_sets(_sets_of(own["text"].tolist(), width), percent, known)
            out += [(ids[k], ids[links.find(k)]) for k in range(len(ids)) if links.find(k) != k]
        B.give_back()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    settled = sent.groupBy("part").applyInPandas(settle, "a long, b long")
    # rows with equal ids are one document: the classes of an id are linked
    held_by = every.where(f"n > 0 and doc_id <> {int(B.NO_ID)}L").select("doc_id", "node").distinct()
    several = held_by.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b < _last")
    same_id = held_by.join(several, "doc_id").select(F.col("node").alias("a"), "b")
    linked = connected_components(settled.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))).unionByName(same_id))
    placed = linked.join(every.groupBy("node").agg(F.min("class_id").alias("class_id")), "node")
    tops = placed.groupBy("component").agg(F.min("class_id").alias("_top"))
    moved = placed.join(tops, "component").where("class_id <> _top").select("node", "_top")
    return every.select("doc_id", "n", "class_id", "node").join(moved, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("_top", "class_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the least id; all columns stay. Rows with equal ids stay together;
    rows with an empty set or a null id have no group and stay."""
    found = components(docs, **options)
    gone = found.where(f"component_id <> doc_id and doc_id <> {int(B.NO_ID)}L").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op8_ngram_jaccard_join(spark, sf_dir):
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return B.with_null_ids(found).select("doc_id", "n_shingles", F.expr(f"nullif(component_id, {int(B.NO_ID)}L)").alias("component_id"))
