"""The engine's operators on fixtures of the survey, against plain Python where the answer is not obvious."""

import math
import random
import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from tessera.api import DB, AgentStore, Client, ConflictError
from tessera.functions import hashing, text
from tessera.operators import fuzzy, graph, keyword, namespaces, sessions, state, transactions, validation, vector, versions
from tessera.operators.levels import Levels
from tessera.plans import planner
from tessera.sources import log as logs
from tessera.streaming import watch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def records(spark, pairs):
    return frame(spark, list(pairs), "key string, value string")


def log_of(spark, rows):
    return frame(spark, [(k, v, op, i) for i, (k, v, op) in enumerate(rows)], "key string, value string, op string, seq long")


def keys(df):
    return [r["key"] for r in df.collect()]


def python_tokens(s):
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s)
    return [x.lower() for x in re.split(r"[^A-Za-z0-9]+", s) if x]


@pytest.mark.parametrize(("given", "want"), [("getUserById", "get user by id"), ("snake_case_name", "snake case name"), ("kebab-case", "kebab case"), ("HTTPServer", "httpserver"), ("a1b2", "a1b2"), ("Kelvin \u212a \u00e9", "kelvin"), ("", "")])
def test_tokens(spark, given, want):
    found = frame(spark, [(given,)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert found == want.split()


def python_bm25(docs, query, k1=1.5, b=0.75):
    terms = {k: python_tokens(k) + python_tokens(v) for k, v in docs}
    avg = sum(map(len, terms.values())) / len(terms)
    scores = Counter()
    for t in python_tokens(query):
        df = sum(t in x for x in terms.values())
        for k, x in terms.items():
            if tf := x.count(t):
                scores[k] += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / avg))
    return sorted(((round(s, 6), k) for k, s in scores.items()), key=lambda x: (-x[0], x[1]))


DOCS = [("auth/jwt.rs", "jwt authentication validate token jwt"), ("auth/basic.rs", "basic authentication password"), ("utils/date.rs", "format date string"), ("models.py::User", "class User: name, token"), ("empty", "")]


def test_bm25(spark):
    docs = records(spark, DOCS)
    found = keyword.bm25(docs, "jwt authentication jwt", 10).collect()
    assert [(r.score, r.key) for r in found] == python_bm25(DOCS, "jwt authentication jwt")
    assert found[0].key == "auth/jwt.rs" and [r["rank"] for r in found] == list(range(len(found)))
    assert keyword.bm25(docs, "nothing", 5).collect() == [] and keyword.bm25(docs, "", 5).collect() == [] and keyword.bm25(docs, "jwt", 0).collect() == []
    batch = keyword.bm25_batch(keyword.index(docs), frame(spark, [(1, "jwt authentication jwt"), (2, "date")], "qid long, text string"), 3)
    assert [(r.score, r.key) for r in batch.where("qid = 1").orderBy("rank").collect()] == python_bm25(DOCS, "jwt authentication jwt")[:3]


SYMBOLS = ["AuthService", "UserRepository", "validateEmail", "hash_password", "send-notification", "getUserById", "verifyToken", "parseConfig", "HttpClient", "DatabasePool"]


@pytest.mark.parametrize(("typo", "want"), [("AuthServce", "AuthService"), ("getUsrById", "getUserById"), ("HASHPASSWORD", "hash_password"), ("sendnotification", "send-notification"), ("verfyToken", "verifyToken")])
def test_fuzzy(spark, typo, want):
    found = fuzzy.search(records(spark, [(s, "v") for s in SYMBOLS]), typo, 3).collect()
    assert found[0].key == want
    if text.is_symbol_like(want) and want.lower().replace("_", "").replace("-", "") == typo.lower():
        assert found[0].distance == 0


def test_fuzzy_table(spark):
    symbols = records(spark, [(s, "v") for s in SYMBOLS])
    asked = ["AuthServce", "getUsrById", "HASHPASSWORD", "zzzzqqqq", "", None, "verfyToken"]
    found = fuzzy.search_table(symbols, frame(spark, list(enumerate(asked)), "qid long, text string"), 3).collect()
    want = [(i, *r) for i, q in enumerate(asked) if q for r in fuzzy.search(symbols, q, 3).select("key", "distance", "jaccard", "rank").collect()]
    assert sorted(map(tuple, found)) == sorted(want)


def test_reads_that_are_kept(spark, tmp_path):
    db = DB(spark, f"file://{tmp_path}/db")
    db.put("a", "1")
    assert db.get("a") == "1" and db.get("b") is None
    db.put("b", "2")
    db.delete("a")
    assert (db.get("a"), db.get("b")) == (None, "2") == (db.get_profiled("a")[0], db.get_profiled("b")[0])
    assert set(db.put_profiled("a", "3")) == {"buffer", "log"} and db.get("a") == "3" and db.delete_range("a", "b") == 1 and db.get("a") is None


def test_fuzzy_bounds(spark):
    docs = records(spark, [(s, s.lower()) for s in SYMBOLS])
    assert fuzzy.search(docs, "zzzzqqqq", 5, 2).collect() == [] and fuzzy.search(docs, "", 5).collect() == []
    assert fuzzy.search_documents(docs, "getUsrById", 2).first().value == "getuserbyid"


def test_vectors(spark):
    rng = random.Random(1)
    rows = [(f"k{i:03d}", [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)] + [("zero", [0.0] * 16), ("short", [1.0])]
    v = frame(spark, rows, "key string, vector array<float>").cache()
    unit = lambda x: [a / math.sqrt(sum(b * b for b in x)) for a in x]
    q = rows[7][1]
    want = sorted((round(1 - sum(a * b for a, b in zip(unit(q), unit(x), strict=True)), 4), k) for k, x in rows[:200])[:10]
    found = vector.knn(v, q, 10).orderBy("rank").collect()
    assert [(round(r.distance, 4), r.key) for r in found] == want and found[0].key == "k007"
    assert vector.knn(v, q, 500).count() == 200 and vector.knn(v, [0.0] * 16, 5).collect() == [] and vector.knn(v, q, 0).collect() == []
    asked = [(i, rows[i][1]) for i in range(20)]
    exact = vector.knn_batch(v, asked, 10).cache()
    assert [r.key for r in exact.where("qid = 7").orderBy("rank").collect()] == [k for _, k in want]
    table = frame(spark, asked, "qid long, vector array<double>")
    assert sorted(map(tuple, vector.knn_table(v, table, 10).collect())) == sorted(map(tuple, exact.select("qid", "key", "distance", "rank").collect()))
    centres = vector.train_cells(v, 8)
    assert vector.recall(vector.ann_batch(vector.assign_cells(v, centres), centres, asked, 10, ef=6), exact).first().recall >= 0.8


EDGES = [("a", "b", "imports"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "d", "inherits"), ("d", "e", "tests"), ("a", "b", "calls"), ("x", "y", "odd")]


def test_graph(spark):
    e = frame(spark, EDGES, "src string, dst string, relation string")
    assert graph.valid(e).count() == 6
    assert sorted(keys(graph.neighbours(e, "a"))) == ["b", "b", "d"] and keys(graph.neighbours(e, "a", "backward")) == ["c"]
    assert keys(graph.neighbours(e, "a", relation="inherits")) == ["d"] and len(keys(graph.neighbours(e, "a", relation="unknown"))) == 3
    depth = {r["key"]: r["depth"] for r in graph.bfs(e, "a", max_depth=9).collect()}
    assert depth == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {r["key"] for r in graph.bfs(e, "a", max_depth=1).collect()} == {"a", "b", "d"}
    assert graph.bfs(e, "nowhere").collect() == [] and sorted(keys(graph.reachable(e, "e", "backward"))) == ["a", "b", "c", "d", "e"]
    assert graph.counts(e).first() == (7, 7)
    order = graph.dfs(e, "a", max_depth=9)
    assert order[0] == ("a", 0) and {k for k, _ in order} == set(depth)


def test_graph_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEVELS", 3)
    e = frame(spark, [(f"n{i}", f"n{i + 1}", "calls") for i in range(11)], "src string, dst string, relation string")
    assert {r.key: r.depth for r in graph.bfs(e, "n0", max_depth=50).collect()} == {f"n{i}": i for i in range(12)}


def test_graph_random(spark):
    rng = random.Random(3)
    pairs = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(90)]
    out, queue = {"0": 0}, deque(["0"])
    while queue:
        at = queue.popleft()
        for a, b in pairs:
            if a == at and b not in out:
                out[b] = out[at] + 1
                queue.append(b)
    e = frame(spark, [(*p, "calls") for p in [("0", "1"), *pairs]], "src string, dst string, relation string")
    found = {r["key"]: r["depth"] for r in graph.bfs(e, "0", max_depth=60).collect()}
    if ("0", "1") in pairs or out.get("1") == 1:
        assert found == out
    assert set(out) <= set(found)


def test_planner():
    spec = planner.QuerySpec
    assert planner.plan(spec(text="getUserById")) == ["fuzzy", "keyword"] and planner.plan(spec(text="plain words")) == ["keyword"]
    assert planner.plan(spec(vector=[1.0])) == ["vector"] and planner.plan(spec(symbol="x")) == ["fuzzy"] and planner.plan(spec()) == []
    assert planner.plan(spec(text="a_b", vector=[1.0], relations=["calls"])) == ["graph", "fuzzy", "keyword", "vector"]
    assert planner.plan(spec(text="a_" + "b" * 40)) == ["keyword"]
    assert [text.is_symbol_like(s) for s in ("getUser", "a::b", "x.y", "a_b", "plain", "two Words", "")] == [True, True, True, True, False, False, False]


def test_rrf_and_hybrid(spark):
    lists = [frame(spark, [(k, i) for i, k in enumerate(x)], "key string, rank long") for x in ("abc", "bad")]
    found = planner.fuse(lists, 10).collect()
    assert [r["key"] for r in found[:2]] == ["a", "b"] and [r["rank"] for r in found] == [0, 1, 2, 3]
    assert found[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    indexes = planner.Indexes(records(spark, [("getUserById", "find a user"), ("sendMail", "mail")]), edges=frame(spark, [("getUserById", "sendMail", "calls")], "src string, dst string, relation string"))
    assert planner.search_documents(indexes, planner.QuerySpec(text="getUsrById")).orderBy("rank").first().key == "getUserById"
    assert {r.key for r in planner.search_documents(indexes, planner.QuerySpec(text="getUserById", relations=["calls"])).collect()} == {"getUserById", "sendMail"}
    assert planner.search(indexes, planner.QuerySpec()).collect() == []


def python_fnv(data):
    h = 14695981039346656037
    for byte in data:
        h = (h ^ byte) * 1099511628211 % (1 << 64)
    return f"{h:016x}"


def test_hashes(spark):
    words = ["", "a", "foobar", "é", "github.com/repo::abc"]
    found = frame(spark, [(w,) for w in words], "w string").select("w", hashing.fnv1a_hex(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in found} == {w: python_fnv(w.encode()) for w in words}
    keys_ = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 2000).alias("held"))
    size = hashing.bloom_size(2000, 0.01)
    told = hashing.bloom_test(keys_, hashing.bloom_build(keys_.where("held"), size), size).join(keys_, "key")
    assert told.where("held and not may_contain").count() == 0 and told.where("not held and may_contain").count() < 60
    assert namespaces.parse("repo@sha") == ("repo", "sha") and namespaces.parse("repo::sha") == ("repo", "sha") and namespaces.parse("repo") == ("repo", "")


def test_state(spark):
    log = log_of(spark, [(f"key_{i:03d}", f"v{i}", "put") for i in range(10)] + [("key_002", "new", "put"), ("key_003", None, "del"), ("gone", "x", "put"), ("gone", None, "del"), ("gone", "back", "put")])
    now = state.live(log)
    assert now.count() == 10 and state.get(now, "key_002").first().value == "new"
    assert keys(state.scan(now, "key_003", "key_007")) == ["key_004", "key_005", "key_006"] and keys(state.scan(now, "b", "a")) == []
    assert keys(state.scan_prefix(now, "key_", 2)) == ["key_000", "key_001"] and keys(state.keys(now, "zzz")) == []
    wanted = frame(spark, [(0, "gone"), (1, "none")], "pos long, key string")
    assert [r.value for r in state.get_batch(now, wanted).orderBy("pos").collect()] == ["back", ""]
    assert {r.key: r.found for r in state.contains(now, wanted.drop("pos")).collect()} == {"gone": True, "none": False}
    tombs = state.tombstones(now, "key_004", "key_006", 99)
    assert state.live(log.unionByName(tombs)).count() == 8
    runs = [log.where("seq <= 9"), log.where("seq > 9 and seq <= 11"), log.where("seq > 11")]
    assert state.compact(runs).count() == 11 and state.compact(runs, True).count() == 10
    assert state.statistics(log).first().records == 10
    assert state.live(log, 9).count() == 10 and state.get(state.live(log, 9), "key_002").first().value == "v2"
    plan = state.get(now, "key_002")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("key_002")  # the filter lies below


def test_log_files(spark, tmp_path):
    rows = [("", f"k{i}", f"v{i}", "put", i) for i in range(20)]
    logs.append(frame(spark, rows, logs.SCHEMA), f"{tmp_path}/log")
    log = logs.read(spark, f"{tmp_path}/log")
    with_crc = log.withColumn("crc", logs.record_crc(F.col("key"), F.col("value")) + F.when(F.col("seq") == 12, 1).otherwise(0))
    assert sorted(r.seq for r in logs.recover(with_crc).collect()) == list(range(12))
    logs.backup(log, f"{tmp_path}/backup", as_of=4)
    assert logs.restore(spark, f"{tmp_path}/backup").count() == 5


def test_versions(spark):
    log = log_of(spark, [("a", "1", "put"), ("b", "1", "put"), ("a", "2", "put"), ("c", "1", "put"), ("b", None, "del")])
    back = versions.restore_records(log, 1, 9)
    assert sorted(map(tuple, state.live(log.unionByName(back)).collect())) == [("a", "1"), ("b", "1")]
    delta = frame(spark, [("a", "mine", "put", 20), ("c", None, "del", 21), ("d", "1", "put", 22)], "key string, value string, op string, seq long")
    now, branch = state.live(log), versions.branch_state(log, 1, delta)
    assert {r.key: (r.live_value, r.branch_value) for r in versions.diff(now, branch).collect()} == {"a": ("2", "mine"), "b": (None, "1"), "c": ("1", None), "d": (None, "1")}
    assert sorted(map(tuple, versions.merge_overlay(now, branch).collect())) == [("a", "mine"), ("b", "1"), ("c", "1"), ("d", "1")]
    assert sorted(map(tuple, versions.merge_delta(now, delta).collect())) == [("a", "mine"), ("d", "1")]


def test_transactions(spark):
    begin, buffer = records(spark, [("alice", "1000"), ("bob", "5")]), frame(spark, [("bob", None, "del", 1), ("eve", "1", "put", 2), ("eve", "2", "put", 3)], "key string, value string, op string, seq long")
    reads = frame(spark, [("alice",), ("bob",), ("eve",), ("none",)], "key string")
    assert {r.key: r.value for r in transactions.read_your_writes(begin, buffer, reads).collect()} == {"alice": "1000", "bob": None, "eve": "2", "none": None}
    now = records(spark, [("alice", "500"), ("bob", "5")])
    assert keys(transactions.conflicts(reads, begin, now)) == ["alice"]
    assert sorted(map(tuple, transactions.commit(now, buffer).collect())) == [("alice", "500"), ("eve", "2")]
    v = frame(spark, [("k", f"v{t}", t) for t in (1, 3, 5, 7)] + [("k", "intent", None), ("j", "x", 2)], "key string, value string, commit_ts long")
    assert {r.key: r.value for r in transactions.visible(v, 5).collect()} == {"k": "v5", "j": "x"} and transactions.visible(v).where("key = 'k'").first().value == "v7"
    assert keys(transactions.committed_since(v, frame(spark, [("k",), ("j",)], "key string"), 2)) == ["k"]
    assert sorted((r.commit_ts or 0, r.value) for r in transactions.collect_garbage(v, 4).where("key = 'k'").collect()) == [(0, "intent"), (3, "v3"), (5, "v5"), (7, "v7")]


def test_validation(spark):
    fields = [validation.Field("key", "String", True), validation.Field("lang", "String", True), validation.Field("lines", "Int", default="0")]
    rows = [("a", "rust", "5"), ("a", None, None), ("a", "rust", "x"), ("a", "rust", " 5 ")]
    told = validation.validate(frame(spark, rows, "key string, lang string, lines string"), fields).collect()
    assert [[e.message for e in r.errors] for r in told] == [[], ["field 'lang' is required"], ["field 'lines': expected Int, got invalid data"], ["field 'lines': expected Int, got invalid data"]]
    kinds = [("1", "Int"), ("-9223372036854775808", "Int"), ("9223372036854775808", "Int"), ("1.0d", "Float"), ("1e5", "Float"), (".5", "Float"), ("nan", "Float"), ("", "Float"), ("TRUE", "Bool"), ("1", "Bool")]
    got = [frame(spark, [(v,)], "v string").select(validation.fits(F.col("v"), k)).first()[0] for v, k in kinds]
    assert got == [True, True, False, False, True, True, True, False, False, True]
    assert validation.apply_defaults(frame(spark, rows, "key string, lang string, lines string"), fields).where("lines = '0'").count() == 1


def test_sessions(spark):
    schema = "session_id string, thread_id string, step long, pos long, type string, content string"
    rows = [("s1", "t", i, i, "Msg" if i % 2 else "Tool", f"text {i}") for i in range(1, 11)] + [("s10", "t", 1, 1, "Msg", "other"), ("bad", "t", 5, 0, "Msg", ""), ("bad", "t", 3, 1, "Msg", ""), ("nameless", "", 1, 0, "Msg", "")]
    r = frame(spark, rows, schema)
    assert {x.session_id: x.valid for x in sessions.validate(r).collect()} == {"s1": True, "s10": True, "bad": False, "nameless": False}
    assert [x.step for x in sessions.recent(r.where("session_id = 's1'"), 3).orderBy("step").collect()] == [8, 9, 10]
    assert sessions.by_type(r, "s1", "Msg").count() == 5 and sessions.delete(r, "s1").where("session_id = 's10'").count() == 1
    assert sessions.search(r, "s1", "10", 1).first().key == "s1:10:Tool"
    calls = frame(spark, [("s", "c1", 1, "Tool", "ls"), ("s", "c1", 2, "Res", "files"), ("s", "c2", 3, "Tool", "open"), ("s", None, 4, "Msg", "hi")], "session_id string, call_id string, step long, type string, content string")
    assert sorted((x.step, x.type) for x in sessions.compress_tools(calls).collect()) == [(1, "Mem"), (3, "Tool"), (4, "Msg")]


def test_watch(spark, tmp_path):
    path, got = f"{tmp_path}/log", []
    logs.append(frame(spark, [("", f"user/{i % 3}", "v", "put", i) for i in range(30)], logs.SCHEMA), path)
    w = watch.Watch("user/1", credit=5)
    assert [r.seq for r in watch.replay(logs.read(spark, path), w, after=2).collect()] == [7, 10, 13]
    sizes = []

    def deliver(df, n):
        rows = df.collect()
        sizes.append(len(rows))
        got.extend(r.seq for r in rows)

    for more in (None, [("", "user/1", "new", "put", 100)], None):
        if more:
            logs.append(frame(spark, more, logs.SCHEMA), path)
        watch.start(spark, path, w, deliver, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    assert got == [*range(1, 30, 3), 100] and sizes == [5, 5, 1]
    with pytest.raises(ValueError):
        list(watch.deliveries(logs.read(spark, path), 0))


def test_database(spark, tmp_path):
    with DB(spark, f"file://{tmp_path}/db") as db:
        db.load({"auth.py::login": "def login token", "user.py::User": "class User", "a": "1"})
        db.put("a", "2")
        db.delete("user.py::User")
        assert db.get("a") == "2" and "user.py::User" not in db and len(db) == 2 and db.get_many(["a", "zz"]) == ["2", ""]
        first = db.snapshot()
        db.put("b", "new")
        assert db.keys() == ["a", "auth.py::login", "b"] and db.scan("auth")[0][1] == "def login token"
        assert db.search("login token")[0].id == "auth.py::login" and db.search_fuzzy("auth.py::logn")[0].content == "def login token"
        db.index("a", [1, 0])
        db.index("b", [0, 1])
        assert [d.id for d in db.search_vector([0.9, 0.1], 1)] == ["a"]
        db.add_edge("a", "calls", "b")
        db.add_edge("a", "unknown", "b")
        assert [d.id for d in db.search_graph("a")][-1] in ("a", "b") and db.stats()["graph_edges"] == 1
        db.restore(first)
        assert db.keys() == ["a", "auth.py::login"] and db.snapshots() == ["snap-0001"]
        with db.agent("x") as agent:
            agent.put("c", "3")
            agent.delete("a")
            assert agent.get("a") is None and db.get("a") == "2" and agent.get("c") == "3"
        assert db.get("c") == "3" and db.get("a") is None
        with pytest.raises(ValueError), db.agent("y") as agent:
            agent.put("lost", "1")
            raise ValueError
        assert db.get("lost") is None
        assert db.delete_range("auth", "auu") == 1
    again = DB(spark, f"file://{tmp_path}/db")
    assert again.keys() == ["c"] and again.snapshots() == [first]
    again.compact()
    assert again.keys() == ["c"]
    with Client.connect(spark, f"file://{tmp_path}/db2") as client:
        space = client.workspace("w")
        space.put("k", "v")
        assert "k" in space and space.scan() == [("k", "v")] and client.context().query("nothing") == []
        assert client.branches() == [] and client.agent("n").get("w/k") == "v" and client.branches() == ["n"]


def test_levels(spark, tmp_path):
    levels = Levels(spark, f"file://{tmp_path}/runs", level_1_bytes=1 << 30)
    schema = "key string, value string, op string, seq long"
    for i in range(5):
        levels.add(frame(spark, [("same", f"v{i}", "put", 10 * i), (f"own{i}", "x", "put", 10 * i + 1)], schema))
    assert len(levels.folders(0)) == 1 and len(levels.folders(1)) == 1
    levels.add(frame(spark, [("own0", None, "del", 99)], schema))
    assert {r.key: r.value for r in levels.state().collect()} == {"same": "v4", **{f"own{i}": "x" for i in range(1, 5)}}
    levels.merge(force=True)
    assert levels.folders(0) == levels.folders(1) == [] and levels.log().count() == 5
    path = f"file://{tmp_path}/log"
    frame(spark, [("new", "1", "put", 200)], schema).write.parquet(path)
    levels.start(spark.readStream.schema(schema).parquet(path), f"file://{tmp_path}/cp", once=True).awaitTermination()
    assert levels.state().where("key = 'new'").count() == 1


def test_transactions_of_the_database(spark, tmp_path):
    db = DB(spark, f"file://{tmp_path}/db")
    db.put("alice", "1000")
    a, b = db.begin("serializable"), db.begin("serializable")
    assert a.get("alice") == b.get("alice") == "1000"
    a.put("alice", "500")
    assert a.get("alice") == "500" and db.get("alice") == "1000" and a.commit() == 1 and a.status == "committed"
    b.put("bob", "1")
    with pytest.raises(ConflictError):
        b.commit()
    c = db.begin()
    c.delete("alice")
    assert c.get("alice") is None
    c.rollback()
    assert db.get("alice") == "500"
    db.backup(f"file://{tmp_path}/backup")
    other = DB(spark, f"file://{tmp_path}/other")
    other.restore_backup(f"file://{tmp_path}/backup")
    assert other.get("alice") == "500"


def test_agent_store(spark, tmp_path):
    store = AgentStore(spark, f"file://{tmp_path}/sessions")
    make = lambda steps, kind="Msg": [{"type": kind, "id": f"r{s}", "thread_id": "t", "step": s, "content": f"text {s}"} for s in steps]
    store.store_payload("s1", make(range(1, 8)))
    store.store_payload("s10", make([1]))
    assert store.append_records("s1", make([7, 8], "Tool")) == 2
    assert [r["step"] for r in store.load_payload("s1")] == [*range(1, 8), 7, 8]
    assert [r["step"] for r in store.get_recent_records("s1", 3)] == [7, 7, 8] and len(store.get_records_by_type("s1", "Tool")) == 2
    assert store.search_records("s1", "8", 1)[0].id == "s1:8:Tool"
    for bad in (make([5, 3]), [{"type": "Msg", "thread_id": "", "step": 1}]):
        with pytest.raises(ValueError):
            store.store_payload("bad", bad)
    store.delete_payload("s1")
    assert [r["session_id"] for r in store.list_sessions()] == ["s10"]
    with pytest.raises(KeyError):
        store.load_payload("s1")


def test_watches_wait_for_credit(spark, tmp_path):
    db = DB(spark, f"file://{tmp_path}/db")
    db.load([(f"user/{i % 2}", str(i)) for i in range(10)])
    watches = db.watches()
    one = watches.watch("user/1", credit=2)
    taken = lambda n: [r.value for r in watches.take(n)]
    assert taken(one) == ["1", "3"] and taken(one) == [] and watches.add_credit(one, 2) == 2
    db.flush()
    db.put("user/1", "last")
    assert taken(one) == ["5", "7"] and watches.add_credit(one, watch.MOST_CREDIT) == watch.MOST_CREDIT == watches.add_credit(one, 9)
    assert taken(one) == ["9", "last"] and taken(watches.watch("user/0", "", 3, after=5)) == ["6", "8"]
    watches.unwatch(one)
    for call in (watches.take, watches.unwatch, lambda n: watches.add_credit(n, 1)):
        with pytest.raises(KeyError):
            call(one)


def test_searches_of_some_keys_and_of_limited_time(spark, tmp_path):
    db = DB(spark, f"file://{tmp_path}/db")
    db.load({"src/a.py": "token one", "src/b.rs": "token two", "doc/c.md": "token"})
    ids = lambda **more: sorted(d.id for d in db.query(planner.QuerySpec(text="token", **more)))
    assert ids() == ["doc/c.md", "src/a.py", "src/b.rs"] and ids(key_like=["src/%"]) == ["src/a.py", "src/b.rs"] and ids(key_like=["%.py", "doc/%"]) == ["doc/c.md", "src/a.py"]
    assert ids(key_like=[]) == [] and ids(timeout=100.0) == ids()
    db.flush()
    assert ids(key_like=["src/%"], timeout=100.0) == ["src/a.py", "src/b.rs"]
    with pytest.raises(TimeoutError):
        db.query(planner.QuerySpec(text="token", timeout=0.001))
    assert ids() == ["doc/c.md", "src/a.py", "src/b.rs"]


def test_database_keeps_what_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = DB(spark, path)
    db.load({"a": "1", "b": "1", "c": "1"})
    db.snapshot("s")
    branch, tx = db.agent("held"), db.begin()
    db.put("a", "2")
    db.delete("b")
    db.put("d", "token words")
    db.delete("d")
    db.put("d", "other token")
    db.compact()
    assert sorted(map(tuple, db.read_snapshot("s").collect())) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert db.scan() == [("a", "2"), ("c", "1"), ("d", "other token")]
    assert branch.get("b") == "1" and tx.get("a") == "1" and [d.id for d in db.search("token")] == ["d"] and db.search("words") == []
    db.put("e", "5")
    db.flush()
    again = DB(spark, path)
    assert again.snapshots() == ["s"] and again.read_snapshot("s").count() == 3 and again.keys() == ["a", "c", "d", "e"]
    again.compact()
    again.compact()
    assert again.read_snapshot("s").count() == 3 and again.get("e") == "5" and [d.id for d in again.search("token")] == ["d"]
    again.index("a", [1, 0])
    again.flush()
    again.index("a", [0, 1])
    again.index("e", [0.6, 0.8])
    again.flush()
    assert {r.key: r.vector for r in DB(spark, path).vectors().collect()} == {"a": [0, 1], "e": [0.6, 0.8]}
    again.build_vector_index(2)
    again.index("c", [1.0, 0.1])
    assert [d.id for d in again.search_vector([1, 0], 3, ef=2)] == [d.id for d in again.search_vector([1, 0], 3)] == ["c", "e", "a"]
    table = spark.range(40).select(F.lit("many").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    again.load_table(table)
    assert again.get("many") == "v39" and [d.id for d in again.search("v39")] == ["many"] and again.search("v38") == []
    assert again.delete_range("m", "n") == 1 and "many" not in again and not again.has_node("a")
    again.add_edge("a", "calls", "c")
    again.backup(f"file://{tmp_path}/backup")
    copy = DB(spark, f"file://{tmp_path}/copy")
    copy.restore_backup(f"file://{tmp_path}/backup")
    assert copy.scan() == again.scan() and copy.snapshots() == ["s"] and copy.has_node("c") and copy.vectors().count() == 3 and copy.search("token")[0].id == "d"


def test_namespaces_and_branches(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = DB(spark, path)
    one, two = db.create_namespace("one"), db.create_namespace("two")
    db.put("k", "main")
    one.put("k", "first token")
    two.load({"k": "second", "l": "token"})
    assert (db.get("k"), one.get("k"), two.get("k")) == ("main", "first token", "second") and db.namespaces() == ["one", "two"]
    assert [d.id for d in two.search("token")] == ["l"] and one.stat() == {"name": "one", "records": 1, "bytes": 12} and "l" not in one
    db.compact()
    assert two.scan("l") == [("l", "token")] and db.delete_namespace("two") == 2 and two.scan() == [] and db.namespaces() == ["one"]
    with pytest.raises(KeyError):
        db.namespace("two")
    db.snapshot("then")
    db.put("k", "later")
    with pytest.raises(KeyError):
        db.agent("x", source="nowhere")
    agent = db.agent("x", source="then")
    assert agent.get("k") == "main"
    agent.put("n", "1")
    assert agent.checkpoint("mark") == "mark"
    agent.put("n", "2")
    agent.checkpoint()
    agent.rollback_to("mark")
    assert agent.get("n") == "1" and agent.checkpoints() == ["mark"]
    agent.save()
    db.flush()
    again = DB(spark, path)
    assert again.branches() == ["x"]
    back = again.agent("x")
    assert back.get("n") == "1" and back.get("k") == "main" and back.commit() == 1 and again.branches() == [] and again.get("n") == "1" and again.get("k") == "later"
    over = again.agent("y", "overlay", "then")
    assert over.commit() == 1 and again.get("k") == "main"


def test_intents(spark):
    v = frame(spark, [("k", "v1", 1, None), ("k", "theirs", None, "t2"), ("j", "x", 5, None)], "key string, value string, commit_ts long, txn string")
    v = transactions.write_intents(v, records(spark, [("k", "mine"), ("n", "new")]), "t1")
    wanted = frame(spark, [("k",), ("j",), ("n",)], "key string")
    see = lambda *a: {r.key: r.value for r in transactions.read(v, wanted, *a).collect()}
    assert see("snapshot", 3, "t1") == {"k": "mine", "j": None, "n": "new"} and see("read_committed", 3, "t9") == {"k": "v1", "j": "x", "n": None}
    done = transactions.commit_keys(v, frame(spark, [("k",)], "key string"), "t1", 7)
    assert sorted((r.key, r.value, r.commit_ts) for r in done.where("key = 'k'").collect() if r.commit_ts) == [("k", "mine", 7), ("k", "v1", 1)]
    assert {r.key: (r.n_versions, r.n_intents) for r in transactions.version_counts(transactions.abort_keys(done, wanted, "t1")).collect()} == {"k": (3, 1), "j": (1, 0)}
    with pytest.raises(ValueError):
        transactions.read(v, wanted, "other", 1, "t")


def test_damaged_log_files_are_told(spark, tmp_path):
    db = DB(spark, f"file://{tmp_path}/db")
    db.load({"a": "1"})
    db.flush()
    (tmp_path / "db" / "log" / "part-bad.parquet").write_bytes(b"no parquet")
    assert db.get("a") == "1" and [x.rsplit("/", 1)[1] for x in db.skipped_files()] == ["part-bad.parquet"]


def test_session_records_of_one_step_keep_their_order(spark):
    r = frame(spark, [("s", 1, i, f"c{i}") for i in range(6)], "session_id string, step long, pos long, content string").repartition(4)
    assert [x.content for x in sessions.load(r, "s").collect()] == [f"c{i}" for i in range(6)]
    assert sorted(x.content for x in sessions.recent(r, 2).collect()) == ["c4", "c5"]


def test_entry_without_the_training_data_package(monkeypatch):
    import sys

    import __spark_entry__ as entry
    from tessera import oracle, queries

    monkeypatch.setitem(sys.modules, "tessera.llm.queries", None)  # importing it fails
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(queries.found) and set(entry.oracle_sql()) == set(oracle.SQL)


def test_scratch_tables_are_swept(spark, tmp_path, monkeypatch):
    from tessera.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    held = scratch.Scratch(spark, "one")
    assert held.table(spark.range(3), "a").count() == 3 and any(tmp_path.rglob("*.parquet"))
    held.drop("a")
    held.table(spark.range(3), "b")
    scratch.sweep(spark)
    assert not any(tmp_path.rglob("*.parquet"))
    file = f"file://{tmp_path}/one-file"
    spark.range(100).coalesce(1).write.parquet(file)
    assert scratch.spread(spark.read.parquet(file)).count() == 100 and scratch.spread(spark.range(5)).count() == 5


def test_every_query_has_sql():
    import __spark_entry__ as entry
    from tessera import queries

    assert set(queries.found) <= set(entry.oracle_sql()) and set(queries.found) <= set(entry.queries())
