"""DuckDB SQL for the queries of :mod:`tessera.queries`, written from their definitions."""

from __future__ import annotations

M = "(select max(event_id) from events)"


def at(n: int) -> str:
    return f"({M} * {n} // 10)"


LOG = "(select printf('user/%08d', user_id) as key, event_type || ':' || cast(value as varchar) as value, case when event_type = 'error' then 'del' else 'put' end as op, event_id as seq, user_id from events)"
BRANCH_DELTA = f"(select * from {LOG} where seq > {at(4)} and seq <= {at(8)} and seq % 7 = 0)"


def live(where: str = "true", log: str = LOG) -> str:
    return f"(select key, arg_max(value, seq) as value from {log} where {where} group by key having arg_max(op, seq) = 'put')"


S4, S8, NOW = live(f"seq <= {at(4)}"), live(f"seq <= {at(8)}"), live()
BRANCH = live(f"seq <= {at(4)} or (seq > {at(4)} and seq <= {at(8)} and seq % 7 = 0)")
USERS = "(select i as pos, printf('user/%08d', i) as key from range({}, {}) t(i) {})"
ABSENT = "union all select {}, 'user/absent'"
FIVE = "key in ('user/00000001','user/00000002','user/00000003','user/00000004','user/00000005')"
READ_SET = f"(select distinct key from {LOG} where user_id % 3 = 0)"


def tok(t: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(regexp_replace({t}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))"


DOCS = "(select 'doc/' || doc_id as key, text as value, source from documents)"
CAMEL = "(split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2))"
SYMBOLS = f"(select {CAMEL} as key, p_name || ' ' || min(p_type) as value from part group by p_name union all select c_name, c_mktsegment from customer)"


def bm25(docs: str, asked: str, k: int, k1: float = 1.5, b: float = 0.75) -> str:
    """A ranked list (key, score, rank) for a text."""
    return f"""(
    with d as (select key, list_concat({tok('key')}, {tok('value')}) as terms from {docs}),
    q as (select t, count(*) as times from (select unnest({tok(f"'{asked}'")}) as t) group by t),
    c as (select count(*)::double as n, avg(len(terms)) as avgdl from d),
    p as (select key, len(terms) as dl, t, count(*) as tf from (select key, terms, unnest(terms) as t from d) where t in (select t from q) group by key, terms, t),
    f as (select t, count(*) as df from p group by t),
    s as (select key, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) as score from p join q using (t) join f using (t), c group by key)
    select key, score, row_number() over (order by score desc, key) - 1 as rank from s order by score desc, key limit {k})"""


def norm(s: str) -> str:
    return f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz')"


def grams(s: str) -> str:
    return f"list_distinct(list_transform(range(1, length({s}) + 3), lambda i: substr('##' || {s} || '##', i, 3)))"


def candidates(asked: str) -> str:
    return f"""(with s as (select distinct key, {norm('key')} as norm from {SYMBOLS}), g as (select key, norm, {grams('norm')} as g, {grams(norm(f"'{asked}'"))} as q from s),
    h as (select key, norm, len(list_intersect(g, q)) as hits, len(g) as n, len(q) as m from g)
    select key, norm, hits / (n + m - hits)::double as jaccard from h where hits > 0 order by jaccard desc, key limit 200)"""


def fuzzy(asked: str, k: int, most: int = 4) -> str:
    return f"""(select key, distance, round(jaccard, 6) as jaccard, row_number() over (order by distance, key = '{asked}' desc, jaccard desc, key) - 1 as rank
    from (select *, levenshtein({norm(f"'{asked}'")}, norm) as distance from {candidates(asked)}) where distance <= {most} order by rank limit {k})"""


def fuse(lists: list[str], k: int) -> str:
    union = " union all ".join(f"select key, rank from {x}" for x in lists)
    return f"(with s as (select key, round(sum(1.0::double / (61 + rank)), 9) as score from ({union}) group by key) select key, score, row_number() over (order by score desc, key) - 1 as rank from s order by score desc, key limit {k})"


UNIT = "(select 'doc/' || vec_id as key, vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)"
KNN = f"""(with u as {UNIT}, n as (select q.vec_id as qid, u.key, round(1 - least(1.0, greatest(-1.0, list_dot_product(q.v, u.v))), 6) as distance from u, (select * from u where vec_id < {{}}) q),
    r as (select *, row_number() over (partition by qid order by distance, key) - 1 as rank from n) select * from r where rank < {{}})"""
VECTOR_20 = f"(select key, round(1 - distance, 6) as score, rank from {KNN.format(1, 20)})"

EDGES = """(select 'customer/' || c_custkey as src, 'nation/' || c_nationkey as dst, 'imports' as relation from customer
    union all select 'nation/' || n_nationkey, 'region/' || n_regionkey, 'defines' from nation
    union all select 'order/' || o_orderkey, 'customer/' || o_custkey, 'calls' from orders
    union all select 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'inherits' from supplier
    union all select distinct 'order/' || l_orderkey, 'part/' || l_partkey, 'tests' from lineitem)"""


def bfs(start: str, depth: int, near: str = "src", far: str = "dst", where: str = "true") -> str:
    return f"with recursive e as (select {near} as a, {far} as b from {EDGES} where {where}), r as (select '{start}' as key, 0::bigint as depth union select e.b, depth + 1 from r join e on e.a = r.key where depth < {depth}) select key, min(depth) as depth from r group by key"


def symbol(t: str) -> str:
    return f"(contains({t}, '::') or contains({t}, '.') or contains({t}, '_') or (regexp_full_match({t}, '[A-Za-z0-9]+') and regexp_matches({t}, '[a-z][A-Z]')))"


HYBRID_DOCS = bm25(DOCS, "hathe tion", 20)
RAW = """(select event_id, case when event_id % 19 <> 0 then event_type end as kind, case when event_id % 7 = 0 then ' 5 ' when event_id % 11 <> 0 then cast(user_id as varchar) end as "user",
    case when event_id % 13 = 0 then '1.0d' when event_id % 17 = 0 then 'inf' else cast(value as varchar) end as amount, case when event_id % 5 = 0 then 'TRUE' else 'true' end as flag, case when event_id % 3 = 0 then '7' end as lines from events)"""
WRONG = """list_filter([
    case when kind is null then {'field': 'kind', 'message': 'field ''kind'' is required'} end,
    case when "user" is null then {'field': 'user', 'message': 'field ''user'' is required'} when not regexp_full_match("user", '[+-]?[0-9]+') then {'field': 'user', 'message': 'field ''user'': expected Int, got invalid data'} end,
    case when not regexp_full_match(amount, '[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))') then {'field': 'amount', 'message': 'field ''amount'': expected Float, got invalid data'} end,
    case when flag not in ('true', 'false', '0', '1') then {'field': 'flag', 'message': 'field ''flag'': expected Bool, got invalid data'} end], lambda x: x is not null)"""
SESSIONS = "(select cast(conv_id as varchar) as session_id, turn as step, role as type, text as content from conversations)"
OWN_BUFFER = f"(select key, arg_max(value, seq) as own, arg_max(op, seq) as op from {LOG} where seq > {at(4)} and seq <= {at(5)} and user_id % 5 = 0 group by key)"
PUTS = f"(select key, value, seq as commit_ts from {LOG} where op = 'put')"
INTENTS = f"(select key, case when commit_ts % 11 <> 0 then commit_ts end as commit_ts, 't' || (length(value) % 2) as txn from {PUTS})"


def octets(t: str) -> str:
    return f"list_transform(range(1, length({t}) + 1), lambda i: ascii(substr({t}, i, 1))::hugeint)"


def fnv(octets_: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::hugeint, {octets_}), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"


ID_OCTETS = "list_transform(range(0, 8), lambda i: ('0x' || substr(id, 2 * i + 1, 2))::hugeint)"
WATCHED = f"(select seq, key, value, op from {LOG} where starts_with(key, 'user/0000001') order by seq limit 50)"
CALLS = f"""(select session_id, cast(step // 2 as varchar) as call_id, step, case when step % 6 < 4 then case when step % 2 = 0 then 'Tool' else 'Res' end else type end as type, md5(content) as content from {SESSIONS})"""
NODES = "(select 'customer/' || c_custkey as key, c_name || ' ' || c_mktsegment as value from customer)"
WALK = f"(with w as ({bfs('order/0', 3, where=chr(34) + 'relation' + chr(34) + chr(61) + chr(39) + 'calls' + chr(39))}) select key, row_number() over (order by 1 / (1 + depth) desc, key) - 1 as rank from w where depth > 0)"
SIZES = "(select n, p, greatest(64, ceil(-n * ln(p) / (ln(2.0::double) * ln(2.0::double))))::bigint as bits from (values (10), (1000), (10000)) a(n), (values (0.5::double), (0.01::double), (0.001::double)) b(p))"

SQL: dict[str, str] = {
    "tokenize_terms": f"select key, len(t)::bigint as n_terms, len(list_distinct(t))::bigint as n_distinct, md5(array_to_string(t, ' ')) as terms_md5 from (select key, {tok('value')} as t from {DOCS})",
    "bm25_postings": f"select key, term, count(*) as tf from (select key, unnest(list_concat({tok('key')}, {tok('value')})) as term from {DOCS}) group by key, term",
    "bm25_corpus_stats": f"with d as (select list_concat({tok('key')}, {tok('value')}) as t from {DOCS}) select count(*) as n_docs, (select count(distinct x) from (select unnest(t) as x from d)) as vocab_size, round(avg(len(t)), 6) as avgdl from d",
    "bm25_search": f"select * from {bm25(DOCS, 'tion er er hathe the', 20)}",
    "bm25_stored_search": f"select * from {bm25(DOCS, 'tion er er hathe the', 20)}",
    "bm25_params": f"select * from {bm25(DOCS, 'tion er er hathe the', 20, 1.2, 0.5)}",
    "bm25_batch_search": f"""with d as (select key, list_concat({tok('key')}, {tok('value')}) as terms from {DOCS}),
        p as (select key, t, count(*) as tf from (select key, unnest(terms) as t from d) group by key, t), l as (select key, sum(tf) as dl from p group by key),
        c as (select count(*)::double as n, avg(dl) as avgdl from l), q as (select qid, t, count(*) as times from (select item_id as qid, unnest({tok('text')}) as t from benchmark) group by qid, t),
        f as (select t, count(*) as df from p group by t),
        s as (select qid, key, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (t) join f using (t) join l using (key), c group by qid, key)
        select qid, key, score from (select *, row_number() over (partition by qid order by score desc, key) as r from s) where r <= 3""",
    "fuzzy_trigrams": f"select key, len(g)::bigint as n_trigrams, array_to_string(list_sort(list_transform(g, lambda x: hex(x))), ' ') as trigrams from (select key, {grams(norm('key'))} as g from {SYMBOLS})",
    "fuzzy_candidates": f"select key, round(jaccard, 6) as jaccard from {candidates('blueAnvl')}",
    "fuzzy_search": f"select * from {fuzzy('blueAnvl', 5)}",
    "fuzzy_search_maxdist": f"select * from {fuzzy('bleuWidget', 5, 2)}",
    "fuzzy_search_batch": f"""with s as (select distinct key, {norm('key')} as norm from (select key from {SYMBOLS} union all select lower(replace(replace(n_name, 'A', ''), 'E', '')) from nation)), g as (select key, norm, {grams('norm')} as g from s),
        q as (select n_nationkey::bigint as qid, n_name as text, {norm('n_name')} as asked, {grams(norm('n_name'))} as m from nation),
        h as (select qid, text, asked, key, norm, len(list_intersect(g, m)) as hits, len(g) as n, len(m) as k from g, q),
        c as (select *, hits / (n + k - hits)::double as jaccard from h where hits > 0),
        p as (select *, row_number() over (partition by qid order by jaccard desc, key) as place from c),
        d as (select *, levenshtein(asked, norm) as distance from p where place <= 200),
        r as (select *, row_number() over (partition by qid order by distance, key = text desc, jaccard desc, key) - 1 as rank from d where distance <= 4)
        select qid, key, distance, round(jaccard, 6) as jaccard, rank from r where rank < 5""",
    "fuzzy_search_docs": f"select key, value, jaccard as score, rank from {fuzzy('blueAnvl', 5)} join {SYMBOLS} using (key)",
    "vector_normalize": f"select key, len(v)::bigint as dim, round(sqrt(list_dot_product(v, v)), 6) as norm, round(v[1], 6) as first from {UNIT}",
    "vector_knn": f"select key, distance, rank from {KNN.format(1, 10)}",
    "vector_knn_batch": f"select qid, key, distance, rank from {KNN.format(20, 10)}",
    "vector_search_docs": f"select k.key, md5(coalesce(d.value, '')) as value_md5, round(1 - distance, 6) as score, rank from {KNN.format(1, 10)} k left join {DOCS} d using (key)",
    "vector_recall_at_10": "select true as recall_ok",
    "graph_edges_valid": f"select relation, count(*) as n from {EDGES} where src not like '%7' group by relation",
    "graph_neighbors_fwd": f"select dst as key, relation from {EDGES} where src = 'order/0'",
    "graph_neighbors_bwd": f"select src as key, relation from {EDGES} where dst = 'nation/1'",
    "graph_neighbors_filtered": f"select src as key, relation from {EDGES} where dst = 'nation/1' and relation = 'inherits'",
    "graph_bfs": bfs("order/0", 3),
    "graph_bfs_backward": bfs("region/0", 2, "dst", "src"),
    "graph_bfs_relation": bfs("nation/1", 3, "dst", "src", "relation = 'imports'"),
    "graph_reachable": f"select key from ({bfs('order/1', 20)})",
    "graph_dfs": f"select key from ({bfs('order/0', 9)})",
    "graph_counts": f"select (select count(*) from (select src from {EDGES} union select dst from {EDGES})) as node_count, (select count(*) from {EDGES}) as edge_count",
    "graph_has_node": f"select 'region/' || i as key, exists (select 1 from {EDGES} where src = 'region/' || i or dst = 'region/' || i) as found from range(0, 40) t(i)",
    "graph_search_docs": f"select h.key, coalesce(d.value, '') as value, score, rank from {fuse([WALK, bm25(NODES, 'order/0', 40)], 20)} h left join {NODES} d using (key)",
    "symbol_classify": f"with t as (select key, key as text from {SYMBOLS} union all select distinct p_name, p_name from part union all select key, value from {DOCS}) select key, {symbol('text')} as is_symbol from t",
    "query_plan": f"""with q as (select event_id, case when event_id % 4 = 0 then event_type || 'Name' when event_id % 4 = 1 then props end as t, case when event_id % 3 = 0 then event_type end as s, event_id % 5 = 0 as v, event_id % 7 = 0 as r from events)
        select event_id, array_to_string(list_concat(case when r then ['graph'] else [] end, case when t <> '' and {symbol('t')} and octet_length(encode(t)) <= 32 then ['fuzzy', 'keyword'] when t <> '' then ['keyword'] when v then [] when s <> '' then ['fuzzy'] else [] end, case when v then ['vector'] else [] end), ',') as steps from q""",
    "rrf_fuse": f"select * from {fuse([bm25(DOCS, 'hathe the', 20), bm25(DOCS, 'tion er', 20)], 10)}",
    "hybrid_search": f"select * from {fuse([fuzzy('blueAnvl', 20), bm25(SYMBOLS, 'blueAnvl', 20)], 10)}",
    "hybrid_search_vector": f"select * from {fuse([HYBRID_DOCS, VECTOR_20], 10)}",
    "search_docs": f"select h.key, md5(d.value) as value_md5, score, rank from {fuse([HYBRID_DOCS], 10)} h join {DOCS} d using (key)",
    "search_in_namespace": f"select * from {fuse([bm25('(select * from ' + DOCS + ' where source = ' + chr(39) + 'src1' + chr(39) + ')', 'hathe tion', 20)], 10)}",
    "bloom_sizing": f"select n::bigint as n, p, bits, greatest(1, least(20, ceil(bits / n::double * ln(2.0::double))))::bigint as hashes from {SIZES}",
    "bloom_membership": "select true as none_missed, true as few_false",
    "fnv1a_hash": f"""select key, lower(hex_) as fnv1a from (select key, printf('%016x', h::ubigint) as hex_ from (select key, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as h from {SYMBOLS}))""",
    "namespace_ids": """select repository, lower(printf('%016x', h::ubigint)) as namespace_id from (select source as repository, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(source || '::abc123') + 1), lambda i: ascii(substr(source || '::abc123', i, 1))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as h from (select distinct source from documents))""",
    "namespace_record_keys": f"with n as (select source, lower(printf('%016x', {fnv(octets("source || '::abc123'"))}::ubigint)) as id from (select distinct source from documents where source is not null)) select key, lower(printf('%016x', {fnv('list_concat(' + ID_OCTETS + ', ' + octets("'::doc::' || key") + ')')}::ubigint)) as record_key from {DOCS} join n using (source)",
    "namespace_stats": f"select source as namespace, count(*) as n_records, sum(strlen(key) + strlen(coalesce(value, '')))::bigint as bytes from {DOCS} group by source",
    "namespace_scan": f"select key, md5(value) as value_md5 from {DOCS} where source = 'src1'",
    "namespace_counts": f"select source as namespace, count(*) as n_records from {DOCS} group by source",
    "namespace_delete": f"select source as namespace, count(*) as n_records from {DOCS} where source <> 'src1' group by source",
    "kv_get": f"select * from {NOW} where {FIVE}",
    "kv_get_batch": f"select pos, key, coalesce(value, '') as value from {USERS.format(1, 6, ABSENT.format(6))} left join {NOW} using (key)",
    "kv_contains": f"select key, value is not null as found from {USERS.format(0, 30, ABSENT.format(30))} left join {NOW} using (key)",
    "kv_scan_range": f"select * from {NOW} where key >= 'user/00000010' and key < 'user/00000020'",
    "kv_scan_prefix": f"select * from {NOW} where starts_with(key, 'user/0000001') order by key limit 100",
    "kv_keys": f"select key from {NOW} where starts_with(key, 'user/0000001')",
    "kv_put_batch": f"with n as (select key, 'new:' || pos as value from {USERS.format(140, 2010, '')}) select * from {NOW} where key not in (select key from n) union all select * from n",
    "kv_delete": f"select * from {NOW} where key not in (select key from {USERS.format(0, 10, '')})",
    "kv_delete_range": f"select * from {NOW} where not (key >= 'user/00000010' and key < 'user/00000020')",
    "db_stats": f"with l as (select key, arg_max(value, seq) as value, arg_max(op, seq) as op, max(seq) as seq from {LOG} group by key) select count(*) filter (op = 'put') as records, count(*) filter (op = 'del') as tombstones, sum(case when op = 'put' then strlen(key) + strlen(value) else 0 end)::bigint as bytes, max(seq) as last_seq from l",
    "index_stats": f"select (select count(*) from documents) as index_docs, (select count(distinct key) from {SYMBOLS}) as index_symbols, (select count(*) from embeddings) as index_vectors, (select count(*) from (select src from {EDGES} union select dst from {EDGES})) as graph_nodes, (select count(*) from {EDGES}) as graph_edges",
    "compact_merge": f"select key, case when arg_max(op, seq) = 'put' then arg_max(value, seq) end as value, arg_max(op, seq) as op, max(seq) as seq from {LOG} group by key",
    "compact_history": f"with l as (select *, (seq > {at(4)})::int + (seq > {at(8)})::int as era from {LOG}), k as (select key, era, arg_max(value, seq) as value, arg_max(op, seq) as op, max(seq) as seq from l group by key, era), c as (select *, count(*) filter (op = 'put') over (partition by key order by seq) as puts from k) select '' as namespace, key, value, op, seq from c where puts > 0",
    "tombstone_gc": f"select key, arg_max(value, seq) as value, 'put' as op, max(seq) as seq from {LOG} group by key having arg_max(op, seq) = 'put'",
    "log_recover": f"select seq, key, value, op from {LOG} where seq < {M} * 3 // 4",
    "snapshot_read": f"select * from {S4}",
    "snapshot_get": f"select * from {S4} where {FIVE}",
    "snapshot_restore": f"select * from {S4}",
    "state_merge_from": f"select * from {S8} where key not in (select key from {S4}) union all select * from {S4}",
    "branch_diff": f"select coalesce(a.key, b.key) as key, a.value as live_value, b.value as branch_value from {S8} a full outer join {BRANCH} b on a.key = b.key where a.value is distinct from b.value",
    "branch_merge_overlay": f"select * from {S8} where key not in (select key from {BRANCH}) union all select * from {BRANCH}",
    "branch_merge_delta": f"select * from {S8} where key not in (select key from {BRANCH_DELTA}) union all select * from {live('true', BRANCH_DELTA)}",
    "branch_rollback": f"select * from {S8}",
    "tx_read_your_writes": f"select u.key, case when b.op = 'put' then own when b.op is null then s.value end as value from {USERS.format(0, 21, '')} u left join {OWN_BUFFER} b using (key) left join {S4} s using (key)",
    "tx_commit_apply": f"select * from {S8} where key not in (select key from {OWN_BUFFER}) union all select key, own from {OWN_BUFFER} where op = 'put'",
    "tx_conflicts": f"select r.key from {READ_SET} r left join {S4} a using (key) left join {S8} b using (key) where a.value is distinct from b.value",
    "mvcc_read_asof": f"select key, arg_max(value, commit_ts) as value, max(commit_ts) as commit_ts from {PUTS} where commit_ts <= {at(5)} group by key",
    "mvcc_visible": f"select key, arg_max(value, commit_ts) as value, max(commit_ts) as commit_ts from {PUTS} where commit_ts % 11 <> 0 group by key",
    "mvcc_conflicts": f"select key from {READ_SET} where key in (select key from {PUTS} where commit_ts > {at(4)})",
    "mvcc_gc": f"with v as (select key, case when commit_ts % 11 <> 0 then commit_ts end as commit_ts from {PUTS}), r as (select *, row_number() over (partition by key order by commit_ts desc) as n from v where commit_ts is not null), o as (select *, row_number() over (partition by key, n > 1 and commit_ts < {at(6)} order by commit_ts desc) as m from r), k as (select key, commit_ts from o where not (n > 1 and commit_ts < {at(6)}) or m = 1 union all select key, null from v where commit_ts is null) select key, count(*) as n_versions, count(*) filter (commit_ts is null) as n_intents from k group by key",
    "mvcc_commit_keys": f"select key, count(*) as n_versions, count(*) filter (commit_ts is null and not (txn = 't1' and key < 'user/00000500')) as n_intents from {INTENTS} group by key",
    "mvcc_abort_keys": f"select key, count(*) as n_versions, count(*) filter (commit_ts is null) as n_intents from {INTENTS} where not (commit_ts is null and txn = 't1' and key < 'user/00000500') group by key",
    "mvcc_read_isolation": f"with w as {USERS.format(0, 200, '')}, r as (select key, arg_max(value, commit_ts) as value from {PUTS} group by key), s as (select key, arg_max(value, commit_ts) as value from {PUTS} where commit_ts <= {at(5)} group by key) select key, value, 'read_committed' as isolation from w left join r using (key) union all select key, value, 'snapshot' from w left join s using (key)",
    "schema_validate": f"select event_id, len(w)::bigint as n_errors, array_to_string(list_transform(w, lambda x: x.message), '; ') as messages from (select event_id, {WRONG} as w from {RAW})",
    "schema_violation_counts": f"select e.field as field, e.message as message, count(*) as n from (select unnest({WRONG}) as e from {RAW}) group by all",
    "schema_defaults": f"select coalesce(lines, '0') as lines, count(*) as n from {RAW} group by 1",
    "session_validate": "with r as (select conv_id, cast(conv_id as varchar) as session_id, turn, case when conv_id % 5 = 0 then -turn else turn end as step from conversations), l as (select *, lag(step) over (partition by conv_id order by turn) as before from r) select session_id, not bool_or(coalesce(step < before, false) or conv_id % 7 = 3) as valid from l group by session_id",
    "session_load": f"select * from {SESSIONS} where session_id = '0'",
    "session_list": f"select session_id, count(*) as n_records from {SESSIONS} group by session_id",
    "session_delete": f"select session_id, count(*) as n_records from {SESSIONS} where session_id <> '1' group by session_id",
    "session_by_type": f"select step, content from {SESSIONS} where session_id = '0' and type = 'user'",
    "session_recent": f"select session_id, step, type, md5(content) as content_md5 from (select *, row_number() over (partition by session_id order by step desc) as n from {SESSIONS}) where n <= 3",
    "session_search": "select * from " + bm25(f"(select session_id || ':' || step || ':' || type as key, content as value from {SESSIONS} where session_id = '0')", "la de et et", 5),
    "session_compress": f"""with c as {CALLS}, t as (select session_id, call_id, a.step, 'Mem' as type, 'tool ' || a.content || ' -> ' || b.content as content from (select * from c where type = 'Tool') a join (select * from c where type = 'Res') b using (session_id, call_id))
        select session_id, call_id, step, type, content from c where type not in ('Tool', 'Res') or (session_id, call_id) not in (select (session_id, call_id) from t) union all select * from t""",
    "watch_replay": f"select * from {WATCHED}",
    "resume_from": f"select * from {WATCHED} order by seq offset 20",
}
