"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
RULES = "(values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(verdict, h, p)"

SQL = {
    "op2_jaccard_join": f"""
        with recursive w as (select doc_id, {FOLDED} as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s from w),
        c as (select doc_id, len(s)::bigint as n, md5(array_to_string(list_sort(s), chr(10))) as class from s),
        reps as (select class, min(doc_id) as rep, count(*) as copies, any_value(n) as n from c where n > 0 group by class),
        e as (select s.doc_id, unnest(s.s) as g from s join reps on rep = s.doc_id),
        o as (select a.doc_id as a, b.doc_id as b, count(*) as shared from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        l as (select o.a, o.b, y.copies from o join reps x on x.rep = o.a join reps y on y.rep = o.b where 100 * shared >= 75 * (x.n + y.n - shared)),
        reach as (select rep as a, rep as b from reps union select reach.a, l.b from reach join l on l.a = reach.b),
        t as (select a, min(b) as component_id from reach group by a),
        k as (select a, sum(copies) as links from l group by a)
        select c.doc_id, c.n as n_shingles, coalesce(component_id, c.doc_id) as component_id, coalesce(rep, c.doc_id) as class_id, case when c.n = 0 then 0 else coalesce(links, 0) + copies - 1 end::bigint as n_links
        from c left join reps on reps.class = c.class and c.n > 0 left join t on t.a = rep left join k on k.a = rep""",
    "op3_substring_dedup": f"""
        with w as (select doc_id, {WORDS} as w from documents),
        x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, unnest(list_transform(range(1, len(w) + 1), lambda i: case when i + 34 <= len(w) then md5(array_to_string(list_slice(w, i, i + 34), ' ')) end)) as h from w),
        c as (select h from x where h is not null group by h having count(*) > 1),
        m as (select x.*, max(case when c.h is not null then 1 else 0 end) over (partition by doc_id order by i rows between 34 preceding and current row) as gone from x left join c using (h)),
        d as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '')) as kept_sha256 from m group by doc_id)
        select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from w left join d using (doc_id)""",
    "op4_url_filter": rf"""
        with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
        f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict from u, {RULES} where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join f using (page_id)""",
    "op6_line_dedup": r"""
        with x as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents),
        v as (select doc_id, i, 3 as n, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d as h from x window d as (partition by doc_id order by i)),
        w as (select * from v where h is not null
              union select doc_id, 0, count(*), string_agg(line, chr(10) order by i) from x group by doc_id having count(*) < 3 and bool_or(regexp_matches(line, '[^\x20\x09-\x0D]'))
              union select doc_id, i, 1, line from x where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
        f as (select h, min({'doc': doc_id, 'i': i}) as first from w group by h having count(*) > 1),
        g as (select distinct doc_id, unnest(range(i, i + n)) as i from w join f using (h) where first.doc <> doc_id or i - first.i >= n),
        m as (select x.doc_id, x.line, x.i, g.i is not null as gone from x left join g on g.doc_id = x.doc_id and g.i = x.i)
        select documents.doc_id, count_if(coalesce(gone, false))::bigint as n_removed, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from documents left join m using (doc_id) group by documents.doc_id""",
    "op7_topk_search": """
        with v as (select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.k as query, q.vec_id as query_id, c.k, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and c.k <> q.k),
        r as (select *, row_number() over (partition by query order by score desc, vec_id, k)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op8_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)""",
    "op9_mixing": f"""
        with d as (select doc_id, source, len({WORDS})::bigint as size from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
        f as (select *, source_size * 2.0::double as "full" from w),
        c as (select *, sum(source_size) over () * 1.5::double - coalesce(sum("full") over (order by "full" / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_, sum(weight) over (order by "full" / weight, source nulls last rows between current row and unbounded following) as rest from f),
        o as (select *, weight * left_ / rest <= "full" as fits from c),
        p as (select *, max(fits::int) over (order by "full" / weight, source nulls last) as open, first_value(left_) over (order by not fits, "full" / weight, source nulls last) as l, first_value(rest) over (order by not fits, "full" / weight, source nulls last) as r from o),
        t as (select source, source_size, case when open = 1 then least("full", weight * l / r) else "full" end as target from p),
        x as (select doc_id, size, source_size, target, case when source_size > 0 then least(target / source_size, 2.0::double) else 0 end as rate, ('0x' || substr(md5('1:' || doc_id), 1, 13))::bigint / 4503599627370496.0::double as u from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, (floor(rate)::bigint + (u < rate - floor(rate))::bigint) * size as taken from x""",
}
