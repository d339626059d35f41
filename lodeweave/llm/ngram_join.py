"""Jaccard self-join on word n-gram sets by prefix trees.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct
runs of five words (the whole sequence if there are fewer). All sets are put in one global
order, rarer n-grams first as far as a counting sketch of fixed size over the whole corpus
can tell, so two linked sets share an n-gram among the first fifth of each.

Documents with equal sets form one node. For every n-gram that several prefixes hold, all
its nodes first meet a few hubs, and the links found so are joined to components; then those
nodes of an n-gram meet that are not in one component yet and whose sizes and positions
still allow a link. Meetings are verified probe by probe: the candidates' ordered sets form
a prefix tree, shared beginnings are counted once, and a subtree is left as soon as what
remains of its longest set or of the probe is too short. Any two linked documents are
thus either verified or already connected by verified links; no pair list of a group of
copies is made. Before any text is fetched again, candidates whose histograms by hash
rule out a link are let go.

Defined results: a null or empty text, or one of white space only, has an empty set, links
with nothing and is its own component; a null doc_id takes part and its component is the
least id that is not null, if any; repeated rows each return a row; an empty table gives
an empty result; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm import text
from lodeweave.llm.components import components
from lodeweave.llm.shared import only_wanted, tidy, unused, written

WORDS = 5
SKETCH = 1 << 20
SKETCH_PARTS = 64
#: Tasks whose counters meet in one group.
FAN = 1024
#: Nodes of one n-gram, or candidates of one probe, that meet in one group at most; more are dealt over several.
BLOCK = 1024
#: Nodes of each n-gram that all others meet first.
HUBS = 1
#: Parts of a set's histogram by hash at least, and of the shorter one that goes with every posting.
PARTS, COARSE = 256, 64
#: Tokens of a set that are counted between two looks at the bound.
STRIDE = 64
#: Two sums of scrambled hashes name a set.
_KEYS = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = WORDS, key: int = 0) -> list[np.ndarray]:
    """Every row's distinct n-gram hashes, in no particular order of rarity."""
    starts, ends, rows = text.words(buf, offs)
    h = text.hashes(buf, starts, ends, text.LOWER, key)
    grams = text.sequences(h, width)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        own = grams[lo : hi - width + 1] if hi - lo >= width else text.sequences(h[lo:hi], hi - lo) if hi > lo else grams[:0]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def twofold_sets(buf: np.ndarray, offs: np.ndarray, keys: tuple[int, int], width: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every row's distinct n-grams by two hashes of independent keys: sorted by the first one, and the other at the same places."""
    starts, ends, rows = text.words(buf, offs)
    h = [text.hashes(buf, starts, ends, text.LOWER, key) for key in keys]
    grams = [text.sequences(x, width) for x in h]
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        one, two = (g[lo : hi - width + 1] if hi - lo >= width else text.sequences(x[lo:hi], hi - lo) if hi > lo else g[:0] for g, x in zip(grams, h, strict=True))
        order = np.argsort(one, kind="stable")
        one, two = one[order], two[order]
        first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
        out.append((one[first], two[first]))
    return out


def sketch(docs: DataFrame, key: int = 0) -> np.ndarray:
    """How many documents' n-grams fall into each of SKETCH counters: summed over FAN tasks at a time, then over those; only the sums reach the driver."""
    part = SKETCH // SKETCH_PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, buf, offs in text.groups(batch.column("text")):
                grams = np.concatenate([*shingle_sets(buf, offs, key=key), np.zeros(0, np.uint64)])
                counts += np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        rows = [counts[k * part : (k + 1) * part].tobytes() for k in range(SKETCH_PARTS)]
        some = TaskContext.get().partitionId() // FAN
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([some] * SKETCH_PARTS, pa.int32()), pa.array(rows, pa.binary())], ["part", "some", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for row in table.column("counts"):
            total += np.frombuffer(row.as_py(), np.int64)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(tidy(counted), "part int, some int, counts binary")
    for by in (["part", "some"], ["part"]):
        parts = parts.groupBy(*by).applyInArrow(summed, "part int, counts binary")
    out = np.zeros(SKETCH, np.int64)
    for r in parts.collect():
        out[r.part * part : (r.part + 1) * part] = np.frombuffer(bytes(r.counts), np.int64)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """How many times a counter exceeds the mean, in powers of two: 0 for all that is not clearly frequent."""
    mean = max(float(counts.mean()), 1.0)
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / mean) - 0.5), 0, 30).astype(np.uint64)


def ordered(grams: np.ndarray, level: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """A set in the global order, as numbers that keep it: level, then hash; `names`: other hashes of the same n-grams to be used for that."""
    return np.sort((level[(grams & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(58)) | ((grams if names is None else names) >> np.uint64(6)))


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def trie_links(probe: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """Which of the ordered sets `members` link with the ordered set `probe`."""
    if not members:
        return []
    order = sorted(range(len(members)), key=lambda i: members[i].astype(">u8").tobytes())
    sets = [members[i] for i in order]
    shared = np.zeros(len(sets), np.int64)  # how long a beginning a set shares with the one before it
    for i in range(1, len(sets)):
        n = min(len(sets[i]), len(sets[i - 1]))
        same = sets[i][:n] == sets[i - 1][:n]
        shared[i] = n if same.all() else int(same.argmin())
    sizes = np.array([len(s) for s in sets])
    n_probe = len(probe)
    found: list[int] = []

    def passed(tokens: np.ndarray) -> tuple[int, int]:
        """How many tokens the probe has too, and how many of its own lie behind the last one."""
        at = np.searchsorted(probe, tokens)
        hits = int((probe[np.minimum(at, n_probe - 1)] == tokens).sum())
        return hits, n_probe - int(np.searchsorted(probe, tokens[-1], "right"))

    stack = [(0, len(sets), 0, 0, n_probe)]
    while stack:
        lo, hi, depth, overlap, rest = stack.pop()
        longest, need = int(sizes[lo:hi].max()), least_overlap(n_probe, int(sizes[lo:hi].min()), percent)
        common = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else longest
        alive = True
        while depth < common:
            if overlap + min(longest - depth, rest) < need:
                alive = False
                break
            step = min(common, depth + STRIDE)
            hits, rest = passed(sets[lo][depth:step])
            overlap += hits
            depth = step
        if not alive or overlap + min(longest - depth, rest) < need:
            continue
        if hi - lo == 1:
            if overlap >= need:
                found.append(order[lo])
            continue
        cuts = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1 : hi] == common)).tolist(), hi]
        stack += [(a, b, depth, overlap, rest) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return found


def histogram(grams: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of its parts, a power of two that grows with the set; full counters (255) bound nothing."""
    parts = PARTS
    while 2 * parts < len(grams):
        parts *= 2
    return np.minimum(np.bincount((grams >> np.uint64(40)).astype(np.int64) & (parts - 1), minlength=parts), 255).astype(np.uint8).tobytes()


def folded(fine: bytes, parts: int) -> np.ndarray:
    """The histogram in fewer parts."""
    counts = np.frombuffer(fine, np.uint8)
    out = counts.reshape(-1, parts).sum(axis=0, dtype=np.int64)
    if (counts == 255).any():
        out[:] = 1 << 40
    return out


def coarse(fine: bytes) -> bytes:
    return np.minimum(folded(fine, COARSE), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """No two sets with these histograms have a larger intersection."""
    parts = min(len(a), len(b))
    return int(np.minimum(folded(a, parts), folded(b, parts)).sum())


def _plausible(pairs: DataFrame, nodes: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms allow a link."""
    few = only_wanted(nodes, wanted, "node")
    one, two = (few.select(F.col("node").alias(f"_{k}"), F.col("n").alias(f"n{k}"), F.col("histogram").alias(f"h{k}")) for k in (1, 2))
    rows = pairs.join(one, F.col("probe") == F.col("_1")).join(two, F.col("member") == F.col("_2")).select("probe", "member", "n1", "n2", "h1", "h2")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = least_overlap(batch.column("n1").to_numpy(), batch.column("n2").to_numpy(), percent).tolist()
            ok = [most_shared(a.as_py(), b.as_py()) >= n for a, b, n in zip(batch.column("h1"), batch.column("h2"), need, strict=True)]
            yield batch.select(["probe", "member"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(tidy(allowed), "probe long, member long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, level: object, percent: int, keys: tuple[int, int]) -> DataFrame:
    """The links (a, b) among candidate pairs (probe, member), a written table, of nodes.

    What met by the first hash is compared by the second one, so n-grams of different words would have to be equal under two independent keys.
    """
    ends = pairs.select(F.col("probe").alias("node")).unionByName(pairs.select(F.col("member").alias("node"))).distinct()
    pairs = written(_plausible(pairs, nodes, ends, percent), "pairs")
    wanted = pairs.select(F.col("probe").alias("node")).unionByName(pairs.select(F.col("member").alias("node"))).distinct()
    places = nodes.join(wanted, "node", "left_semi").select("node", F.col("rep_doc").alias("_doc"), F.col("rep_text").alias("_text"))
    texts = only_wanted(docs.select("text", "doc_id", F.xxhash64("text").alias("_hash")), places.select(F.col("_text").alias("_hash")), "_hash")
    found = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text"))).select("node", "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for _, _, buf, offs in text.groups(batch.column("text")):
                got += [ordered(g, level.value, names).tobytes() for g, names in twofold_sets(buf, offs, keys)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(got, pa.binary())], ["node", "grams"])

    sets = written(found.mapInArrow(tidy(listed), "node long, grams binary"), "sets")
    many = pairs.groupBy("probe").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).alias("salts"))
    salt = F.pmod(F.xxhash64("member"), F.col("salts"))
    members = pairs.join(many, "probe").select("probe", "member", salt.alias("salt")).join(sets, F.col("member") == F.col("node")).select("probe", "salt", "member", "grams", F.lit(1).alias("side"))
    probes = many.join(sets, F.col("probe") == F.col("node")).select("probe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("probe").alias("member"), "grams", F.lit(0).alias("side"))
    met = probes.unionByName(members).repartition("probe", "salt").sortWithinPartitions("probe", "salt", "side", "member")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, ids, held = None, None, [], []

        def links() -> list[tuple[int, int]]:
            return [(key[0], ids[i]) for i in trie_links(probe, held, percent)] if key is not None else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            for p, s, member, side, grams in zip(*(batch.column(c).to_pylist() for c in ("probe", "salt", "member", "side", "grams")), strict=True):
                if (p, s) != key:
                    out += links()
                    key, probe, ids, held = (p, s), None, [], []
                if side == 0:
                    probe = np.frombuffer(grams, np.uint64)
                elif not ids or ids[-1] != member:  # repeated rows of a document give its set more than once
                    ids.append(member)
                    held.append(np.frombuffer(grams, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        out = links()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return written(met.mapInArrow(tidy(checked), "a long, b long"), "found")


def meetings(token: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray, brief: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows with equal token whose groups differ and whose sizes, positions and histograms allow a link. Rows come sorted by token and n."""
    found, alive, step = [np.zeros((0, 2), np.int64)], np.arange(len(token)), 1
    while len(alive):
        alive = alive[alive + step < len(token)]
        other = alive + step
        ok = (token[alive] == token[other]) & (100 * n[alive] >= percent * n[other])
        alive, other = alive[ok], other[ok]  # sizes grow, so what fails here fails farther on
        rest = 1 + np.minimum(n[alive] - at[alive] - 1, n[other] - at[other] - 1)
        need = least_overlap(n[alive], n[other], percent)
        good = np.flatnonzero((group[alive] != group[other]) & (rest >= need))
        for lo in range(0, len(good), 1 << 16):
            i, j = alive[good[lo : lo + (1 << 16)]], other[good[lo : lo + (1 << 16)]]
            low = np.minimum(brief[i], brief[j])
            ok = (low.sum(axis=1, dtype=np.int64) >= need[good[lo : lo + (1 << 16)]]) | (low == 255).any(axis=1)
            found.append(np.stack([node[i[ok]], node[j[ok]]], axis=1))
        step += 1
    return np.unique(np.concatenate(found), axis=0)


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's summary (doc_id, rep_text, n, k1, k2), and every node with its component (a node number)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = text.new_key(), text.new_key()
    level = docs.sparkSession.sparkContext.broadcast(levels(sketch(docs, keys[0])))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums, shares, brief, prefixes = [], [], [], [], []
            for _, _, buf, offs in text.groups(batch.column("text")):
                for grams, names in twofold_sets(buf, offs, keys):
                    own = ordered(grams, level.value)
                    n.append(len(own))
                    sums.append([int(np.sum(text.mix(g ^ seed), dtype=np.uint64).view(np.int64)) for g, seed in zip((grams, names), _KEYS, strict=True)])
                    shares.append(histogram(grams))
                    brief.append(coarse(shares[-1]))
                    prefixes.append(own[: len(own) + -percent * len(own) // 100 + 1].astype(np.int64))
            flat = np.concatenate([*prefixes, np.zeros(0, np.int64)])
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            columns = [batch.column("doc_id"), batch.column("rep_text"), pa.array(n, pa.int64()), *(pa.array([k[i] for k in sums], pa.int64()) for i in (0, 1)), pa.array(shares, pa.binary()), pa.array(brief, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rep_text", "n", "k1", "k2", "histogram", "brief", "prefix"])

    summary = docs.withColumn("rep_text", F.xxhash64("text")).mapInArrow(tidy(summarised), "doc_id long, rep_text long, n long, k1 long, k2 long, histogram binary, brief binary, prefix array<long>")
    summary = written(summary, "prefixes")
    # One node per different set; its representative row is where its text can be found again.
    least = F.min(F.struct("doc_id", "rep_text"))
    nodes = summary.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("min_doc"), least.alias("rep"), F.first("histogram").alias("histogram"), F.first("brief").alias("brief"))
    nodes = written(nodes.select("k1", "k2", "n", "min_doc", "histogram", "brief", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.rep_text").alias("rep_text")), "nodes")
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())

    own = nodes.select("node", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "rep_doc", F.col("rep_text").alias("_rep"))
    here = summary.where("n > 0").join(own, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("rep_text") == F.col("_rep")))
    rows = written(here.select("node", "n", "prefix"), "sorted").select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = rows.groupBy(F.col("token").alias("_token")).agg(F.min("node").alias("one"), F.max("node").alias("other"), F.count("*").alias("held")).where("one < other").select("_token", "held")
    rows = written(rows.join(shared, F.col("token") == F.col("_token")).select("token", "node", "n", "at", "held"), "postings")
    # The nodes whose n-grams are shared the most stand in the middle of a group of near copies: they are its hubs.
    middle = rows.groupBy(F.col("node").alias("_node")).agg(F.sum("held").alias("weight"))
    weighed = rows.join(middle, F.col("node") == F.col("_node")).select("token", "node", "n", "at", "weight")
    order = Window.partitionBy("token").orderBy(F.desc("weight"), "node")
    hubs = weighed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= HUBS)
    hubs = hubs.select(F.col("token").alias("_token"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"))

    possible = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (
        F.least(F.col("n") - F.col("at"), F.col("hub_n") - F.col("hub_at")) >= F.ceil(percent * (F.col("n") + F.col("hub_n")) / (100 + percent) - 1e-9)
    )
    first = rows.join(hubs, F.col("token") == F.col("_token")).where(F.col("node") != F.col("hub")).where(possible)
    first = written(first.select(F.greatest("hub", "node").alias("member"), F.least("hub", "node").alias("probe")).distinct(), "hubs")
    links = _verified(first, nodes, docs, level, percent, keys)
    tied = written(components(links), "tied")

    grouped = rows.where("held > 2").join(tied, "node", "left").withColumn("group", F.coalesce("component", "node"))
    mixed = grouped.groupBy(F.col("token").alias("_token")).agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1").select("_token")
    grouped = grouped.join(mixed, F.col("token") == F.col("_token"), "left_semi")
    grouped = grouped.join(nodes.select(F.col("node").alias("_node"), "brief"), F.col("node") == F.col("_node"))
    grouped = grouped.select("token", "held", "node", "n", "at", "group", "brief")
    # Sizes of linked sets lie in one band or in two next to each other; each pair of bands of an n-gram with many nodes meets by itself.
    band = F.floor(F.ln("n") / np.log(100 / percent * 1.0001))
    large = grouped.where(F.col("held") > BLOCK).withColumn("band", F.explode(F.array(band - 1, band)))
    crowd = large.groupBy(F.col("token").alias("_token"), F.col("band").alias("_band")).agg((F.floor((F.count("*") - 1) / BLOCK) + 1).alias("blocks"))
    large = large.join(crowd, (F.col("token") == F.col("_token")) & (F.col("band") == F.col("_band"))).drop("_token", "_band")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    large = large.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.withColumn("sub", F.least(block, "k") * F.col("blocks") + F.greatest(block, "k"))
    small = grouped.where(F.col("held") <= BLOCK).withColumns({"band": F.lit(0).cast("long"), "sub": F.lit(0).cast("long")})
    kept = ["token", "band", "sub", "node", "n", "at", "group", "brief"]
    dealt = small.select(*kept).unionByName(large.select(*kept)).repartition("token", "band", "sub").sortWithinPartitions("token", "band", "sub", "n", "node")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            token, band, sub, node, n, at, group = (t.column(c).to_numpy() for c in ("token", "band", "sub", "node", "n", "at", "group"))
            key = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (band[1:] != band[:-1]) | (sub[1:] != sub[:-1]))]) if len(token) else token
            brief = np.frombuffer(b"".join(t.column("brief").to_pylist()), np.uint8).reshape(-1, COARSE)
            found = meetings(key, node, n, at.astype(np.int64), group, brief, percent)
            return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], ["probe", "member"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            token, band, sub = (held.column(c).to_numpy() for c in ("token", "band", "sub"))
            last = np.flatnonzero((token == token[-1]) & (band == band[-1]) & (sub == sub[-1]))[0] if len(token) else 0  # the last group may go on in the next batch
            yield pairs(held.slice(0, last))
            held = held.slice(last)
        if held is not None:
            yield pairs(held)

    second = dealt.mapInArrow(tidy(paired), "probe long, member long").distinct()
    second = written(second.join(first, ["probe", "member"], "left_anti"), "rest")
    links = _verified(second, nodes, docs, level, percent, keys).unionByName(links)
    tied = components(links)

    labelled = nodes.join(tied, "node", "left").select("k1", "k2", "min_doc", "rep_doc", "rep_text", F.coalesce("component", "node").alias("component"))
    return summary.select("doc_id", "rep_text", "n", "k1", "k2"), written(labelled, "labelled")


def classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links are 100 * intersection >= percent * union."""
    summary, labelled = _grouped(docs, percent)
    smallest = labelled.groupBy(F.col("component").alias("_c")).agg(F.min("min_doc").alias("component_id"))
    labels = labelled.join(smallest, F.col("component") == F.col("_c")).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "component_id")
    full = summary.where("n > 0").join(labels, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(summary.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of each component, and all rows with empty sets.

    Of rows with equal ids and texts one stays, whichever; null ids come before others.
    """
    summary, labelled = _grouped(docs, percent)
    doc, body, mark = (unused(docs, name) for name in ("_doc", "_text", "_hash"))
    first = labelled.groupBy("component").agg(F.min(F.struct("rep_doc", "rep_text")).alias("r")).select(F.col("r.rep_doc").alias(doc), F.col("r.rep_text").alias(body))
    keep = first.unionByName(summary.where("n = 0").select(F.col("doc_id").alias(doc), F.col("rep_text").alias(body)).distinct())
    rows = docs.withColumn(mark, F.xxhash64("text"))
    match = rows["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (rows[mark] == F.col(body))
    again = written(summary.where("n > 0").groupBy(F.col("doc_id").alias(doc), F.col("rep_text").alias(body)).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return rows.join(keep, match, "left_semi").select(*docs.columns)
    same = F.col(f"k.{doc}").eqNullSafe(F.col(f"a.{doc}")) & (F.col(f"k.{body}") == F.col(f"a.{body}"))
    twice, once = (keep.alias("k").join(again.alias("a"), same, how) for how in ("left_semi", "left_anti"))
    doubled = rows.join(twice, match, "left_semi").dropDuplicates(["doc_id", mark])
    return rows.join(once, match, "left_semi").unionByName(doubled).select(*docs.columns)
