"""One query for each operator over the driver's tables. :mod:`tessera.oracle` holds their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T
from .functions import hashing, text
from .operators import fuzzy, graph, keyword, namespaces, sessions, state, transactions, validation, vector, versions
from .plans import planner
from .sources import log as logs
from .sources.scratch import Scratch
from .streaming import watch

QUERY = "tion er er hathe the"
SYMBOL = "blueAnvl"
RANGE = ("user/00000010", "user/00000020")
PREFIX = "user/0000001"
FIELDS = [
    validation.Field("kind", "String", required=True),
    validation.Field("user", "Int", required=True),
    validation.Field("amount", "Float"),
    validation.Field("flag", "Bool"),
    validation.Field("lines", "Int", required=True, default="0"),
]
found: dict = {}


def query(f):
    found[f.__name__] = f
    return f


def _users(spark, low: int, high: int, absent: bool = False) -> DataFrame:
    rows = spark.range(low, high).select(F.col("id").alias("pos"), T.user_key("id").alias("key"))
    return rows.unionByName(spark.range(1).select(F.lit(high).cast("long").alias("pos"), F.lit("user/absent").alias("key"))) if absent else rows


def _tenths(log: DataFrame, n: int) -> int:
    return T.last_seq(log) * n // 10


# ---- text and keyword search


@query
def tokenize_terms(spark, d):
    terms = T.documents(spark, d).select("key", text.tokens(F.col("value")).alias("t"))
    return terms.select("key", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query
def bm25_postings(spark, d):
    return keyword.postings(T.documents(spark, d))


@query
def bm25_corpus_stats(spark, d):
    return keyword.corpus_statistics(T.documents(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query
def bm25_search(spark, d):
    return keyword.bm25(T.documents(spark, d), QUERY, 20)


def _stored_postings(spark, d):
    return Scratch(spark, "postings").table(keyword.index(T.documents(spark, d)), "postings")


@query
def bm25_stored_search(spark, d):
    return keyword.search(_stored_postings(spark, d), QUERY, 20)


@query
def bm25_params(spark, d):
    return keyword.bm25(T.documents(spark, d), QUERY, 20, 1.2, 0.5)


@query
def bm25_batch_search(spark, d):
    asked = T.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return keyword.bm25_batch(_stored_postings(spark, d), asked, 3).drop("rank")


# ---- symbols


@query
def fuzzy_trigrams(spark, d):
    grams = T.symbols(spark, d).select("key", text.trigrams(text.normalise_symbol(F.col("key"))).alias("g"))
    return grams.select("key", F.size("g").cast("long").alias("n_trigrams"), F.array_join(F.sort_array("g"), " ").alias("trigrams"))


@query
def fuzzy_candidates(spark, d):
    return fuzzy.candidates(T.symbols(spark, d), SYMBOL).select("key", F.round("jaccard", 6).alias("jaccard"))


@query
def fuzzy_search(spark, d):
    return fuzzy.search(T.symbols(spark, d), SYMBOL, 5)


@query
def fuzzy_search_maxdist(spark, d):
    return fuzzy.search(T.symbols(spark, d), "bleuWidget", 5, 2)


@query
def fuzzy_search_batch(spark, d):
    asked = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("text"))
    words = T.symbols(spark, d).select("key").unionByName(T.table(spark, d, "nation").select(F.lower(F.translate("n_name", "AE", "")).alias("key")))
    return fuzzy.search_table(words, asked, 5)


@query
def fuzzy_search_docs(spark, d):
    return fuzzy.search_documents(T.symbols(spark, d), SYMBOL, 5)


# ---- vectors


def _query_vectors(spark, d, n):
    rows = T.vectors(spark, d).where(F.col("vec_id") < n).orderBy("vec_id").collect()
    return [(r["vec_id"], list(r["vector"])) for r in rows]


@query
def vector_normalize(spark, d):
    unit = vector.normalise(T.vectors(spark, d))
    return unit.select("key", F.size("vector").cast("long").alias("dim"), F.round(vector.norm(F.col("vector")), 6).alias("norm"), F.round(F.element_at("vector", 1), 6).alias("first"))


@query
def vector_knn(spark, d):
    return vector.knn(T.vectors(spark, d), _query_vectors(spark, d, 1)[0][1], 10)


@query
def vector_knn_batch(spark, d):
    return vector.knn_batch(T.vectors(spark, d), _query_vectors(spark, d, 20), 10)


@query
def vector_search_docs(spark, d):
    hits = vector.search(T.vectors(spark, d), _query_vectors(spark, d, 1)[0][1], 10)
    docs = T.documents(spark, d).join(F.broadcast(hits), "key", "right")  # k rows
    return docs.select("key", F.md5(F.coalesce("value", F.lit(""))).alias("value_md5"), "score", "rank")


@query
def vector_recall_at_10(spark, d):
    v = T.vectors(spark, d)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "vector")
    centres = vector.train_cells(v)
    index = Scratch(spark, "cells").table(vector.assign_cells(v, centres), "cells")
    near = vector.ann_table(index, centres, asked, 10, ef=12)
    return vector.recall(near, vector.knn_table(v, asked, 10)).select((F.col("recall") >= 0.9).alias("recall_ok"))


# ---- graph


def _edges(spark, d):
    """The relations as a table: a walk reads it once a step."""
    return Scratch(spark, "edges").table(T.edges(spark, d), "edges")


@query
def graph_edges_valid(spark, d):
    odd = T.edges(spark, d).withColumn("relation", F.when(F.col("src").endswith("7"), "unknown").otherwise(F.col("relation")))
    return graph.valid(odd).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_neighbors_fwd(spark, d):
    return graph.neighbours(T.edges(spark, d), "order/0")


@query
def graph_neighbors_bwd(spark, d):
    return graph.neighbours(T.edges(spark, d), "nation/1", "backward")


@query
def graph_neighbors_filtered(spark, d):
    return graph.neighbours(T.edges(spark, d), "nation/1", "backward", "inherits")


@query
def graph_bfs(spark, d):
    return graph.bfs(_edges(spark, d), "order/0", "forward", 3).select("key", "depth")


@query
def graph_bfs_backward(spark, d):
    return graph.bfs(_edges(spark, d), "region/0", "backward", 2).select("key", "depth")


@query
def graph_bfs_relation(spark, d):
    return graph.bfs(_edges(spark, d), "nation/1", "backward", 3, "imports").select("key", "depth")


@query
def graph_reachable(spark, d):
    return graph.reachable(_edges(spark, d), "order/1")


@query
def graph_dfs(spark, d):
    return spark.createDataFrame(graph.dfs(_edges(spark, d), "order/0", "forward", 9), "key string, depth long").select("key")


@query
def graph_counts(spark, d):
    return graph.counts(T.edges(spark, d))


@query
def graph_has_node(spark, d):
    wanted = spark.range(0, 40).select(F.concat(F.lit("region/"), F.col("id").cast("string")).alias("key"))
    return graph.has_node(T.edges(spark, d), wanted)


@query
def graph_search_docs(spark, d):
    nodes = T.table(spark, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("key"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("value"))
    spec = planner.QuerySpec(text="order/0", relations=["calls"], top_k=20)
    return planner.search_documents(planner.Indexes(nodes, edges=_edges(spark, d)), spec)


# ---- planner and fusion


@query
def symbol_classify(spark, d):
    raw = T.table(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_name").alias("text")).distinct()
    every = T.symbols(spark, d).select("key", F.col("key").alias("text")).unionByName(raw).unionByName(T.documents(spark, d).select("key", F.col("value").alias("text")))
    return every.select("key", text.looks_symbol_like(F.col("text")).alias("is_symbol"))


@query
def query_plan(spark, d):
    e = T.table(spark, d, "events")
    i = F.col("event_id")
    asked = e.select("event_id", F.when(i % 4 == 0, text.camel(F.concat_ws(" ", "event_type", F.lit("name")))).when(i % 4 == 1, F.col("props")).alias("text"), F.when(i % 3 == 0, F.col("event_type")).alias("symbol"), (i % 5 == 0).alias("has_vector"), (i % 7 == 0).alias("has_relations"))
    return asked.select("event_id", planner.plan_column(F.col("text"), F.col("symbol"), F.col("has_vector"), F.col("has_relations")).alias("steps"))


@query
def rrf_fuse(spark, d):
    post = _stored_postings(spark, d)
    return planner.fuse([keyword.search(post, "hathe the", 20), keyword.search(post, "tion er", 20)], 10)


@query
def hybrid_search(spark, d):
    return planner.search(planner.Indexes(T.symbols(spark, d)), planner.QuerySpec(text=SYMBOL, top_k=10))


@query
def hybrid_search_vector(spark, d):
    spec = planner.QuerySpec(text="hathe tion", vector=_query_vectors(spark, d, 1)[0][1], top_k=10)
    return planner.search(planner.Indexes(T.documents(spark, d), T.vectors(spark, d)), spec)


@query
def search_docs(spark, d):
    hits = planner.search_documents(planner.Indexes(T.documents(spark, d)), planner.QuerySpec(text="hathe tion", top_k=10))
    return hits.select("key", F.md5("value").alias("value_md5"), "score", "rank")


@query
def search_in_namespace(spark, d):
    docs = namespaces.scan(T.documents(spark, d), "src1")
    return planner.search(planner.Indexes(docs), planner.QuerySpec(text="hathe tion", top_k=10))


# ---- hashing


@query
def bloom_sizing(spark, d):
    rows = [(n, p, *vars(hashing.bloom_size(n, p)).values()) for n in (10, 1_000, 10_000) for p in (0.5, 0.01, 0.001)]
    return spark.createDataFrame(rows, "n long, p double, bits long, hashes long")


@query
def bloom_membership(spark, d):
    keys = T.table(spark, d, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("key"), (F.col("o_orderkey") % 2 == 0).alias("held"))
    size = hashing.bloom_size(keys.count() // 2 + 1, 0.01)
    bloom = hashing.bloom_build(keys.where("held"), size)
    told = hashing.bloom_test(keys, bloom, size).join(keys, "key")
    missed = F.count_if(F.col("held") & ~F.col("may_contain")) == 0
    return told.agg(missed.alias("none_missed"), (F.count_if(~F.col("held") & F.col("may_contain")) < 0.03 * F.count_if(~F.col("held"))).alias("few_false"))


@query
def fnv1a_hash(spark, d):
    return T.symbols(spark, d).select("key", hashing.fnv1a_hex(F.col("key")).alias("fnv1a"))


# ---- namespaces


@query
def namespace_ids(spark, d):
    named = T.documents(spark, d).select(F.col("namespace").alias("repository"), F.lit("abc123").alias("commit")).distinct()
    return namespaces.identify(named).select("repository", "namespace_id")


@query
def namespace_record_keys(spark, d):
    named = namespaces.identify(T.documents(spark, d).withColumn("commit", F.lit("abc123")), "namespace", "commit")
    return named.where("namespace_id is not null").select("key", hashing.record_key(F.col("namespace_id"), F.lit("doc"), F.col("key")).alias("record_key"))


@query
def namespace_stats(spark, d):
    return namespaces.statistics(T.documents(spark, d))


@query
def namespace_scan(spark, d):
    return namespaces.scan(T.documents(spark, d), "src1").select("key", F.md5("value").alias("value_md5"))


@query
def namespace_counts(spark, d):
    return namespaces.counts(T.documents(spark, d))


@query
def namespace_delete(spark, d):
    return namespaces.counts(namespaces.delete(T.documents(spark, d), "src1"))


# ---- keyed records


@query
def kv_get(spark, d):
    return state.live(T.change_log(spark, d)).where(F.col("key").isin([f"user/{i:08d}" for i in range(1, 6)] + ["user/absent"]))


@query
def kv_get_batch(spark, d):
    return state.get_batch(state.live(T.change_log(spark, d)), _users(spark, 1, 6, absent=True))


@query
def kv_contains(spark, d):
    return state.contains(state.live(T.change_log(spark, d)), _users(spark, 0, 30, absent=True))


@query
def kv_scan_range(spark, d):
    return state.scan(state.live(T.change_log(spark, d)), *RANGE)


@query
def kv_scan_prefix(spark, d):
    return state.scan_prefix(state.live(T.change_log(spark, d)), PREFIX, 100)


@query
def kv_keys(spark, d):
    return state.keys(state.live(T.change_log(spark, d)), PREFIX)


@query
def kv_put_batch(spark, d):
    log = T.change_log(spark, d).select("key", "value", "op", "seq")
    more = _users(spark, 140, 2_010).select("key", F.concat(F.lit("new:"), F.col("pos").cast("string")).alias("value"), F.lit("put").alias("op"), (F.lit(T.last_seq(log) + 1) + F.col("pos")).alias("seq"))
    return state.live(log.unionByName(more))


@query
def kv_delete(spark, d):
    log = T.change_log(spark, d).select("key", "value", "op", "seq")
    gone = _users(spark, 0, 10).select("key", F.lit(None).cast("string").alias("value"), F.lit("del").alias("op"), F.lit(T.last_seq(log) + 1).cast("long").alias("seq"))
    return state.live(log.unionByName(gone))


@query
def kv_delete_range(spark, d):
    log = T.change_log(spark, d).select("key", "value", "op", "seq")
    return state.live(log.unionByName(state.tombstones(state.live(log), *RANGE, T.last_seq(log) + 1)))


@query
def db_stats(spark, d):
    return state.statistics(T.change_log(spark, d))


@query
def index_stats(spark, d):
    docs = keyword.corpus_statistics(T.documents(spark, d)).select(F.col("n_docs").alias("index_docs"))
    syms = T.symbols(spark, d).agg(F.count_distinct("key").alias("index_symbols"))
    vecs = T.vectors(spark, d).agg(F.count(F.lit(1)).alias("index_vectors"))
    graph_ = graph.counts(T.edges(spark, d)).select(F.col("node_count").alias("graph_nodes"), F.col("edge_count").alias("graph_edges"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [docs, syms, vecs, graph_])  # one row each


def _runs(log: DataFrame) -> list[DataFrame]:
    half = _tenths(log, 5)
    log = log.withColumn("value", F.when(F.col("op") == "put", F.col("value")))
    step = (T.last_seq(log) - half) // 4 + 1
    cuts = [half + step * i for i in range(5)]
    return [log.where(F.col("seq") <= half)] + [log.where((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]


@query
def compact_merge(spark, d):
    return state.compact(_runs(T.change_log(spark, d)))


@query
def compact_history(spark, d):
    log = T.change_log(spark, d).withColumn("namespace", F.lit(""))
    return state.compact_history(log, [_tenths(log, 4), _tenths(log, 8)])


@query
def tombstone_gc(spark, d):
    return state.compact(_runs(T.change_log(spark, d)), drop_tombstones=True)


@query
def log_recover(spark, d):
    log = T.change_log(spark, d)
    bad = T.last_seq(log) * 3 // 4
    crc = logs.record_crc(F.col("key"), F.col("value"))
    return logs.recover(log.withColumn("crc", F.when(F.col("seq") == bad, crc + 1).otherwise(crc))).select("seq", "key", "value", "op")


# ---- snapshots and branches


def _branch(log):
    base, now = _tenths(log, 4), _tenths(log, 8)
    delta = log.where((F.col("seq") > base) & (F.col("seq") <= now) & (F.col("seq") % 7 == 0))
    return state.live(log, now), versions.branch_state(log, base, delta), delta


@query
def snapshot_read(spark, d):
    log = T.change_log(spark, d)
    return versions.snapshot(log, _tenths(log, 4))


@query
def snapshot_get(spark, d):
    return snapshot_read(spark, d).where(F.col("key").isin([f"user/{i:08d}" for i in range(1, 6)]))


@query
def snapshot_restore(spark, d):
    log = T.change_log(spark, d).select("key", "value", "op", "seq")
    back = versions.restore_records(log, _tenths(log, 4), T.last_seq(log) + 1)
    return state.live(log.unionByName(back))


@query
def state_merge_from(spark, d):
    log = T.change_log(spark, d)
    return versions.merge_overlay(state.live(log, _tenths(log, 8)), state.live(log, _tenths(log, 4)))


@query
def branch_diff(spark, d):
    now, branch, _ = _branch(T.change_log(spark, d))
    return versions.diff(now, branch)


@query
def branch_merge_overlay(spark, d):
    now, branch, _ = _branch(T.change_log(spark, d))
    return versions.merge_overlay(now, branch)


@query
def branch_merge_delta(spark, d):
    now, _, delta = _branch(T.change_log(spark, d))
    return versions.merge_delta(now, delta)


@query
def branch_rollback(spark, d):
    return _branch(T.change_log(spark, d))[0]


# ---- transactions and versions


@query
def tx_read_your_writes(spark, d):
    log = T.change_log(spark, d)
    begin, end = _tenths(log, 4), _tenths(log, 5)
    buffer = log.where((F.col("seq") > begin) & (F.col("seq") <= end) & (F.col("user_id") % 5 == 0))
    return transactions.read_your_writes(state.live(log, begin), buffer, _users(spark, 0, 21).select("key"))


@query
def tx_commit_apply(spark, d):
    log = T.change_log(spark, d)
    begin, end = _tenths(log, 4), _tenths(log, 5)
    buffer = log.where((F.col("seq") > begin) & (F.col("seq") <= end) & (F.col("user_id") % 5 == 0))
    return transactions.commit(state.live(log, _tenths(log, 8)), buffer)


@query
def tx_conflicts(spark, d):
    log = T.change_log(spark, d)
    reads = log.where("user_id % 3 = 0").select("key").distinct()
    return transactions.conflicts(reads, state.live(log, _tenths(log, 4)), state.live(log, _tenths(log, 8)))


def _versions(log, intents=False):
    stamp = F.when(F.col("seq") % 11 != 0, F.col("seq")) if intents else F.col("seq")
    return log.where("op = 'put'").select("key", "value", stamp.alias("commit_ts"))


@query
def mvcc_read_asof(spark, d):
    log = T.change_log(spark, d)
    return transactions.visible(_versions(log), _tenths(log, 5))


@query
def mvcc_visible(spark, d):
    return transactions.visible(_versions(T.change_log(spark, d), intents=True))


@query
def mvcc_conflicts(spark, d):
    log = T.change_log(spark, d)
    reads = log.where("user_id % 3 = 0").select("key").distinct()
    return transactions.committed_since(_versions(log), reads, _tenths(log, 4))


@query
def mvcc_gc(spark, d):
    log = T.change_log(spark, d)
    kept = transactions.collect_garbage(_versions(log, intents=True), _tenths(log, 6))
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("commit_ts").isNull()).alias("n_intents"))


def _intents(log):
    """Versions of one transaction (t0 or t1) for each key, some of them uncommitted."""
    return _versions(log, intents=True).withColumn("txn", F.concat(F.lit("t"), (F.length("value") % 2).cast("string")))


@query
def mvcc_commit_keys(spark, d):
    log = T.change_log(spark, d)
    done = transactions.commit_keys(_intents(log), _users(spark, 0, 500).select("key"), "t1", T.last_seq(log) + 1)
    return transactions.version_counts(done)


@query
def mvcc_abort_keys(spark, d):
    return transactions.version_counts(transactions.abort_keys(_intents(T.change_log(spark, d)), _users(spark, 0, 500).select("key"), "t1"))


@query
def mvcc_read_isolation(spark, d):
    log, wanted = T.change_log(spark, d), _users(spark, 0, 200).select("key")
    seen = [transactions.read(_versions(log).withColumn("txn", F.lit("t0")), wanted, level, _tenths(log, 5), "t1").withColumn("isolation", F.lit(level)) for level in ("read_committed", "snapshot")]
    return seen[0].unionByName(seen[1])


# ---- validation


@query
def schema_validate(spark, d):
    told = validation.validate(T.raw_records(spark, d), FIELDS)
    return told.select("event_id", F.size("errors").cast("long").alias("n_errors"), F.array_join(F.col("errors.message"), "; ").alias("messages"))


@query
def schema_violation_counts(spark, d):
    told = validation.validate(T.raw_records(spark, d), FIELDS).select(F.explode("errors").alias("e"))
    return told.groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query
def schema_defaults(spark, d):
    return validation.apply_defaults(T.raw_records(spark, d), FIELDS).groupBy("lines").agg(F.count(F.lit(1)).alias("n"))


# ---- sessions


@query
def session_validate(spark, d):
    records = T.sessions(spark, d)
    odd = F.col("session_id").cast("long") % 5 == 0
    records = records.withColumn("step", F.when(odd, -F.col("step")).otherwise(F.col("step"))).withColumn("thread_id", F.when(F.col("session_id").cast("long") % 7 == 3, "").otherwise(F.col("thread_id")))
    return sessions.validate(records)


@query
def session_load(spark, d):
    return sessions.load(T.sessions(spark, d), "0").select("session_id", "step", "type", "content")


@query
def session_list(spark, d):
    return sessions.sessions(T.sessions(spark, d))


@query
def session_delete(spark, d):
    return sessions.sessions(sessions.delete(T.sessions(spark, d), "1"))


@query
def session_by_type(spark, d):
    return sessions.by_type(T.sessions(spark, d), "0", "user").select("step", "content")


@query
def session_recent(spark, d):
    return sessions.recent(T.sessions(spark, d), 3).select("session_id", "step", "type", F.md5("content").alias("content_md5"))


@query
def session_search(spark, d):
    return sessions.search(T.sessions(spark, d), "0", "la de et et", 5)


@query
def session_compress(spark, d):
    records = T.sessions(spark, d).withColumn("call_id", F.expr("cast(step div 2 as string)"))
    kind = F.when(F.col("step") % 2 == 0, "Tool").otherwise("Res")
    records = records.withColumn("type", F.when(F.col("step") % 6 < 4, kind).otherwise(F.col("type"))).withColumn("content", F.md5("content"))
    return sessions.compress_tools(records)


# ---- watching


@query
def watch_replay(spark, d):
    return watch.replay(T.change_log(spark, d), watch.Watch(PREFIX, credit=50)).select("seq", "key", "value", "op")


@query
def resume_from(spark, d):
    return watch.replay(T.change_log(spark, d), watch.Watch(PREFIX, credit=50), after=20).select("seq", "key", "value", "op")
