"""Queries of the bibliographic operators, with SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bib as B
from ..operators import crossref as C
from ..operators import files as A
from ..operators import history as H
from ..operators import identity as I
from ..operators import insertion as N
from ..operators import keys as K
from ..operators import merge as M
from ..operators import search as S
from ..tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "bib_entry")


# pieces of SQL
def fv(name: str) -> str:
    return f"coalesce(field_map['{name}'], '')"


def hasf(name: str) -> str:
    return f"coalesce(list_contains(map_keys(field_map), '{name}'), false)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


STD = rf"list_transform(string_split({fv('author')}, ' and '), lambda x: case when contains({strip('x')}, ',') then {strip('x')} else regexp_replace({strip('x')}, '^(.*) ([^ ]*)$', '\2, \1', 's') end)"
FAM = f"list_transform({STD}, lambda y: split_part(y, ',', 1))"


def simp(x: str) -> str:
    return strip(rf"lower(regexp_replace({x}, '[^\x00-\x80]', '_', 'g'))")


ATID = f"{simp(f'array_to_string({FAM}, chr(32))')} || {simp(fv('title'))}"
FILES = "list_filter(list_transform(list_filter(string_split(coalesce(field_map['file'], ''), ';'), lambda x: x <> ''), lambda x: case len(string_split(x, ':')) when 1 then x when 2 then split_part(x, ':', 1) else array_to_string(list_slice(string_split(x, ':'), 2, len(string_split(x, ':')) - 1), ':') end), lambda p: p <> '')"
KEYWORDS = f"list_filter(list_transform(string_split({fv('keywords')}, ','), lambda k: {strip('k')}), lambda k: k <> '')"
FULL = "array_to_string(list_concat([coalesce(entry_type, ''), coalesce(cite_key, '')], list_transform(list_sort(map_keys(field_map)), lambda k: field_map[k])), ' ')"
VALID = (
    "(regexp_matches(lower({x}), '^10\\.[0-9]{{4,9}}/[-._;()/:a-z0-9]*[-_;()/a-z0-9]$') and len({x}) > 8 and not regexp_matches(lower({x}), '/-/dc|\\.pdf|[a-z0-9._/-](preprint|received|published|edited|advance|full|abstract|supplement)|-supplement')"
    " and not (ends_with({x}, ')') and len({x}) - len(replace({x}, ')', '')) > len({x}) - len(replace({x}, '(', ''))))"
)
VDOI = VALID.format(x=fv("doi"))


# --- search ---------------------------------------------------------------------------------------------------
@query(f"select rec_id from bib_entry where {hasf('title')} and contains(lower({fv('title')}), 'kelp') and contains(lower({fv('title')}), 'current')")
def list_title_all(spark, d):
    return S.select(bib(spark, d), S.by_field("title", ["Kelp", "current"])).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('title')} and (contains(lower({fv('title')}), 'kelp') or contains(lower({fv('title')}), 'albedo'))")
def list_title_any(spark, d):
    return S.select(bib(spark, d), S.by_field("title", ["kelp", "ALBEDO"], any_=True)).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('title')} and not contains(lower({fv('title')}), 'of') and not contains(lower({fv('title')}), 'in')")
def list_invert_all(spark, d):
    return S.select(bib(spark, d), S.by_field("title", ["of", "in"], invert=True)).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('title')} and (not contains(lower({fv('title')}), 'of') or not contains(lower({fv('title')}), 'in'))")
def list_invert_any(spark, d):
    return S.select(bib(spark, d), S.by_field("title", ["of", "in"], invert=True, any_=True)).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('journal')} and regexp_full_match(lower({fv('journal')}), '.*of .* [a-m][a-z]*', 's')")
def list_strict_glob(spark, d):
    return S.select(bib(spark, d), B.has("journal") & F.lower(B.field("journal")).rlike(r"(?s)^(?:.*of .* [a-m][a-z]*)$")).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('journal')} and regexp_full_match(lower({fv('journal')}), 'water l.dger|[n-z].*', 's')")
def list_glob_any(spark, d):
    return S.select(bib(spark, d), S.by_field("journal", ["Water L?dger", "[n-z]*"], strict=True, any_=True)).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('year')} and contains(lower({fv('year')}), '201')")
def list_year(spark, d):
    return S.select(bib(spark, d), S.by_field("year", ["201"])).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('doi')} and contains(lower({fv('doi')}), 'jts')")
def list_doi(spark, d):
    return S.select(bib(spark, d), S.by_field("doi", ["JTS"])).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('keywords')} and contains(lower({fv('keywords')}), 'ocean') and contains(lower({fv('abstract')}), 'the') and {hasf('abstract')}")
def list_keywords_abstract(spark, d):
    return S.select(bib(spark, d), S.by_field("keywords", ["ocean"]), S.by_field("abstract", ["the"])).select("rec_id")


@query("select rec_id from bib_entry where contains(lower(coalesce(cite_key, '')), 'ski')")
def list_key(spark, d):
    return S.select(bib(spark, d), S.by_key(["SKI"])).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('author')} and contains(lower({FAM}[1]), 'ovski')")
def list_first_author(spark, d):
    return S.select(bib(spark, d), S.by_author(["ovski"], first=True)).select("rec_id")


@query(f"select rec_id from bib_entry where {hasf('author')} and contains(lower(array_to_string({FAM}, ' ')), 'berg') and contains(lower(array_to_string({FAM}, ' ')), 'enko')")
def list_author(spark, d):
    return S.select(bib(spark, d), S.by_author(["berg", "enko"])).select("rec_id")


@query(f"select rec_id from bib_entry where contains(lower({FULL}), 'wendelsee') and contains(lower({FULL}), 'kelp')")
def list_fullsearch(spark, d):
    return S.select(bib(spark, d), S.everywhere(["Wendelsee", "kelp"])).select("rec_id")


@query(f"select rec_id, {fv('file')} <> '' as has_file from bib_entry")
def list_has_file(spark, d):
    return bib(spark, d).select("rec_id", S.has_file().alias("has_file"))


@query(f"""with l as (select rec_id, lib, unnest({FILES}) as path from bib_entry), live as (select distinct lib, file_path as path, true as there from lib_file where deleted_ts is null)
select distinct rec_id from l left join live using (lib, path) where there is null""")
def list_broken_file(spark, d):
    live = A.listing(read(spark, d, "lib_file")).select("lib", "path")
    return A.links(bib(spark, d)).join(live, ["lib", "path"], "left_anti").select("rec_id").distinct()


@query(f"""select rec_id from bib_entry where not (coalesce(cite_key, '') <> '' and not regexp_matches(coalesce(cite_key, ''), '^[0-9]')) or ({fv('doi')} <> '' and not {VDOI})
or {fv('author')} = '' or {fv('title')} = '' or {fv('year')} = ''""")
def list_review_required(spark, d):
    return S.select(bib(spark, d), S.needs_review()).select("rec_id")


@query()
def list_fuzzy(spark, d):
    """Titles like a phrase by token-set ratio (no SQL: Arrow UDF)."""
    return S.select(bib(spark, d).where("map_contains_key(field_map, 'title')"), S.leaf(B.field("title"), "gradual kelp of the wendelsee", fuzzy=70)).select("rec_id")


@query("select rec_id, cite_key from bib_entry where cite_key in (select min(cite_key) from bib_entry union all select max(cite_key) from bib_entry)")
def check_keys_subset(spark, d):
    """Records of given keys only."""
    b = bib(spark, d)
    ends = b.agg(F.array(F.min("cite_key"), F.max("cite_key")).alias("k")).select(F.explode("k").alias("cite_key"))
    return S.of_keys(b, ends).select("rec_id", "cite_key")


# --- output ---------------------------------------------------------------------------------------------------
@query(f"""select rec_id, coalesce(cite_key, '') || ': ' || substr({fv('title')}, 1, 60) || case when len({fv('title')}) > 60 then '...' else '' end || ' ' ||
case when {fv('doi')} <> '' or len({FILES}) > 0 or {fv('keywords')} <> '' then '(' || array_to_string(list_filter([case when {fv('doi')} <> '' then 'doi:' || {fv('doi')} end,
case when len({FILES}) = 1 then 'file:1' when len({FILES}) > 1 then 'files:' || len({FILES}) end, case when {fv('keywords')} <> '' then array_to_string({KEYWORDS}, ' | ') end], lambda x: x is not null), ', ') || ')' else '' end as line from bib_entry""")
def list_one_liner(spark, d):
    return bib(spark, d).select("rec_id", S.one_liner().alias("line"))


@query(f"select rec_id, {fv('year')} || ' ' || {fv('journal')} || ' ' || {fv('volume')} as line from bib_entry")
def list_fields(spark, d):
    return bib(spark, d).select("rec_id", S.selected_fields(["year", "journal", "volume"]).alias("line"))


@query("select distinct lib, cite_key from bib_entry where cite_key is not null")
def list_keys(spark, d):
    return bib(spark, d).where("cite_key is not null").select("lib", "cite_key").distinct()


@query(f"select rec_id, array_to_string({STD}, ' and ') as names from bib_entry")
def standard_names(spark, d):
    return bib(spark, d).select("rec_id", F.array_join(B.standard_names(B.field("author")), " and ").alias("names"))


@query(f"select rec_id, array_to_string({FAM}, '|') as families from bib_entry")
def author_families(spark, d):
    return bib(spark, d).select("rec_id", F.array_join(B.family_names(B.field("author")), "|").alias("families"))


@query(f"select keyword, count(*) as n from (select unnest({KEYWORDS}) as keyword from bib_entry) group by 1")
def keyword_counts(spark, d):
    return bib(spark, d).select(F.explode(B.keywords(B.field("keywords"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query(f"select rec_id, array_to_string({FILES}, '|') as paths from bib_entry where {fv('file')} <> ''")
def file_links(spark, d):
    return bib(spark, d).where(B.field("file") != "").select("rec_id", F.array_join(B.attachments(B.field("file")), "|").alias("paths"))


@query(f"""select rec_id, array_to_string(list_transform({FILES}, lambda x: ':' || x || ':' || regexp_extract(x, '\\.([^./]*)$', 1)), ';') as packed from bib_entry where {fv('file')} <> ''""")
def file_field(spark, d):
    return bib(spark, d).where(B.field("file") != "").select("rec_id", B.pack_attachments(B.attachments(B.field("file"))).alias("packed"))


@query(rf"select rec_id, regexp_replace({fv('title')}, '([^{{]|^)([A-Z])([^}}]|$)', '\1{{\2}}\3', 'g') as title from bib_entry where {fv('title')} <> ''")
def protected_titles(spark, d):
    return bib(spark, d).where(B.field("title") != "").select("rec_id", B.protect_uppercase(B.field("title")).alias("title"))


@query()
def decoded_titles(spark, d):
    """Titles and authors with LaTeX decoded (no SQL: Arrow UDF)."""
    from ..functions.latex import to_unicode_udf

    return bib(spark, d).select("rec_id", to_unicode_udf(B.field("title")).alias("title"), to_unicode_udf(B.field("author")).alias("author"))


@query()
def encoded_titles(spark, d):
    """Titles in LaTeX (no SQL: Arrow UDF)."""
    from ..functions.latex import to_latex_udf

    return bib(spark, d).select("rec_id", to_latex_udf(B.field("title")).alias("title"))


# --- identity and duplicates ----------------------------------------------------------------------------------
@query(f"select rec_id, lower({fv('doi')}) as doi_id, {ATID} as at_id from bib_entry")
def entry_ids(spark, d):
    return I.identities(bib(spark, d)).select("rec_id", "doi_id", "at_id")


@query(f"""with k as (select rec_id, {fv('doi')} as k, {VDOI} as ok from bib_entry), g as (select k, min(rec_id) as group_first, count(*) as n from k group by k)
select rec_id, group_first, n, n > 1 and ok as duplicate from k join g using (k)""")
def dup_doi(spark, d):
    return I.grouped_by(bib(spark, d), B.field("doi"), valid=B.valid_doi(B.field("doi")))


@query(f"""with k as (select rec_id, {simp(fv('title'))} as k from bib_entry), g as (select k, min(rec_id) as group_first, count(*) as n from k group by k)
select rec_id, group_first, n, n > 1 as duplicate from k join g using (k)""")
def dup_title(spark, d):
    return I.grouped_by(bib(spark, d), B.title_id())


@query(f"""with k as (select rec_id, {fv('doi')} as k, {VDOI} as ok from bib_entry), g as (select k, count(*) as n from k group by k)
select rec_id from k join g using (k) where not (n > 1 and ok)""")
def uniq_doi(spark, d):
    return dup_doi(spark, d).where("not duplicate").select("rec_id")


@query("""with b as (select lib, rec_id, seq, lower(coalesce(cite_key, '')) as k from bib_entry),
f as (select *, case when lag(k) over (partition by lib order by seq, rec_id) <> k or lag(k) over (partition by lib order by seq, rec_id) is null then 1 else 0 end as fresh from b),
r as (select lib, rec_id, sum(fresh) over (partition by lib order by seq, rec_id rows unbounded preceding)::bigint as run from f)
select lib, rec_id, run, count(*) over (partition by lib, run) as n from r""")
def dup_key_runs(spark, d):
    return I.adjacent_runs(bib(spark, d), F.lower(F.coalesce("cite_key", F.lit(""))), "lib", ["seq", "rec_id"])


@query(f"""with i as (select rec_id, nullif(lower({fv('doi')}), '') as d, nullif({ATID}, '') as a from bib_entry),
gd as (select d, min(rec_id) as doi_class, count(*) as n_doi from i where d is not null group by d), ga as (select a, min(rec_id) as at_class, count(*) as n_at from i where a is not null group by a)
select rec_id, doi_class, at_class, coalesce(n_doi, 0) as n_doi, coalesce(n_at, 0) as n_at from i left join gd using (d) left join ga using (a)""")
def dup_candidates(spark, d):
    return I.classes(bib(spark, d))


_BEST = f"""with i as (select rec_id, lower({fv('doi')}) as d, {fv('doi')} as r, {ATID} as a, coalesce(entry_type, '') as t, coalesce(cite_key, '') as k,
array_to_string(list_transform(list_sort(map_keys(field_map)), lambda x: x || chr(30) || field_map[x]), chr(31)) as f from bib_entry),
e as (select rec_id, case when d <> '' or a <> '' then min(rec_id) over (partition by t, k, f, d || chr(31) || a) end as m104, case when d <> '' or a <> '' then min(rec_id) over (partition by d, a) end as m103,
case when r <> '' then min(rec_id) over (partition by r) end as m102, case when d <> '' then min(rec_id) over (partition by d) end as d101, case when a <> '' then min(rec_id) over (partition by a) end as a101 from i),
l as (select rec_id, case when m104 < rec_id then m104 end as x, case when m103 < rec_id then m103 end as g, case when m102 < rec_id then m102 end as fa, case when d101 < rec_id then d101 end as pd, case when a101 < rec_id then a101 end as pa from e),
best as (select rec_id, case when x is not null then 104 when g is not null then 103 when fa is not null then 102 when pd is not null or pa is not null then 101 end::bigint as level, coalesce(x, g, fa, least(pd, pa)) as match from l) """


@query(_BEST + "select * from best where level is not null")
def similarity_levels(spark, d):
    return I.best_earlier(bib(spark, d))


@query(_BEST + "select rec_id, match from best where level >= 103")
def dups_good(spark, d):
    return I.best_earlier(bib(spark, d)).where("level >= 103").select("rec_id", "match")


@query(_BEST + "select rec_id, match from best where level >= 102")
def dups_fair(spark, d):
    return I.best_earlier(bib(spark, d)).where("level >= 102").select("rec_id", "match")


@query(_BEST + "select level, count(*) as n from best where level is not null group by level")
def level_counts(spark, d):
    return I.best_earlier(bib(spark, d)).groupBy("level").agg(F.count("*").alias("n"))


@query()
def greedy_groups(spark, d):
    """First-match greedy groups at the PARTIAL level, in order (no SQL: a fixpoint)."""
    return I.greedy_groups(bib(spark, d))


SCORE = f"((100 * ({fv('doi')} <> '' and {VDOI})::bigint + 50 * ({hasf('title')})::bigint + 10 * ({hasf('author')})::bigint + ({hasf('file')})::bigint) * 100 + coalesce(cardinality(field_map), 0))::bigint"


@query(f"select rec_id, {SCORE} as score from bib_entry")
def record_score(spark, d):
    return bib(spark, d).select("rec_id", B.record_score().alias("score"))


@query(f"""with m as (select distinct group_no, rec_id from dup_link), s as (select group_no, rec_id, {SCORE} as score from m join bib_entry using (rec_id))
select group_no, rec_id, score from (select *, row_number() over (partition by group_no order by score desc, rec_id desc) as r from s) where r = 1""")
def best_entry(spark, d):
    return I.best_record(_members(spark, d), "group_no")


@query("""select min(rec_id) as first, count(*) as copies from bib_entry group by coalesce(entry_type, ''), coalesce(cite_key, ''),
array_to_string(list_transform(list_sort(map_keys(field_map)), lambda x: x || chr(30) || field_map[x]), chr(31))""")
def exact_unique(spark, d):
    return I.exact_unique(bib(spark, d))


# --- merging --------------------------------------------------------------------------------------------------
def _members(spark, d) -> DataFrame:
    return bib(spark, d).join(read(spark, d, "dup_link").distinct(), "rec_id")


_V = """with m as (select distinct group_no, rec_id from dup_link), e as (select group_no, rec_id, unnest(map_entries(field_map)) as kv from m join bib_entry using (rec_id)),
v as (select group_no, kv.key as field, kv.value as value, min(rec_id) as first from e group by all),
g as (select group_no, field, count(*) as n_values, sum((value <> '')::bigint)::bigint as n_filled, case when sum((value <> '')::bigint) = 1 then max(case when value <> '' then value end) when sum((value <> '')::bigint) = 0 then '' end as merged from v group by 1, 2)"""


@query(_V + " select * from g")
def merge_fields(spark, d):
    return M.merge_fields(_members(spark, d), "group_no")


@query(_V + f""", s as (select group_no, rec_id, row_number() over (partition by group_no order by {SCORE} desc, rec_id desc) as r from m join bib_entry using (rec_id)),
b as (select group_no, kv.key as field, kv.value as best from s join e using (group_no, rec_id) where r = 1 and kv.value <> ''),
f as (select group_no, field, min((first, value))[2] as fv from v group by 1, 2)
select group_no, field, coalesce(merged, best, fv) as value from g left join b using (group_no, field) join f using (group_no, field)""")
def merge_resolved(spark, d):
    return M.merge_resolved(_members(spark, d), "group_no")


@query("""with m as (select distinct group_no, rec_id from dup_link), l as (select group_no, rec_id, lib, unnest(F) as path, generate_subscripts(F, 1) as pos from m join bib_entry using (rec_id)),
p as (select group_no, path, min((rec_id, pos)) as place0 from l group by 1, 2) select group_no, path, row_number() over (partition by group_no order by place0) as place from p""".replace("unnest(F)", f"unnest({FILES})").replace("subscripts(F,", f"subscripts({FILES},"))
def merge_files(spark, d):
    """Attachments of a group: each different path once, in order."""
    from ..operators.ordered import rank

    l = _members(spark, d).select("group_no", "rec_id", F.posexplode(B.attachments(B.field("file"))).alias("pos", "path"))
    p = l.groupBy("group_no", "path").agg(F.min(F.struct("rec_id", "pos")).alias("at")).select("group_no", "path", "at.rec_id", "at.pos")
    return rank(p, ["group_no"], ["rec_id", "pos"], "place").select("group_no", "path", "place")


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """The library before 2022, and the batch of what came later."""
    b = bib(spark, d)
    cut = F.lit("2022-01-01").cast("timestamp_ntz")
    return b.where(F.col("added_ts").cast("timestamp_ntz") < cut), b.where(F.col("added_ts").cast("timestamp_ntz") >= cut)


_N = "2305843009213693952"
_H = (
    f"with recursive src as (select rec_id + case when added_ts >= timestamp '2022-01-01' then {_N} else 0 end as rec_id, field_map, entry_type, cite_key from bib_entry where added_ts is not null), "
    + _BEST.replace("with i as", "i as").replace("from bib_entry", "from src")
    + f""", lk as (select rec_id as ord, match from best where level is not null and rec_id >= {_N}), w as (select ord, match as root from lk union all select w.ord, lk.match from w join lk on w.root = lk.ord),
c as (select ord, root from w where root not in (select ord from lk)),
m as (select rec_id as ord, list_concat(map_entries(coalesce(field_map, MAP {{}}::map(varchar, varchar))), [{{'key': 'ENTRYTYPE', 'value': coalesce(entry_type, '')}}, {{'key': 'ID', 'value': coalesce(cite_key, '')}}]) as kvs from src),
p as (select coalesce(c.root, s.rec_id) as entry, case when c.root is null then -1 else rec_id end as nth, unnest({FILES}) as path, generate_subscripts({FILES}, 1) as pos from src s left join c on c.ord = s.rec_id),
q as (select entry, path, min((nth, pos)) as place from p where entry in (select root from c) group by all),
f as (select entry, 'file' as field, string_agg(':' || path || ':' || regexp_extract(path, '\\.([^./]*)$', 1), ';' order by place) as value from q group by entry), """
)
_X = f"select case when entry >= {_N} then entry - {_N} else entry end as entry, field, value from (select * from z where field <> 'file' or entry not in (select entry from f) union all select * from f)"
_A = "ev as (select coalesce(c.root, m.ord) as entry, case when c.root is null then -1 else m.ord end as nth, unnest(kvs) as kv from m left join c using (ord)), z as (select entry, kv.key as field, {f}(kv.value, nth) as value from ev group by 1, 2) "


@query(_H + _A.format(f="arg_min") + _X)
def insert_update_missing(spark, d):
    return N.insert_checked(*_halves(spark, d), mode="u")


@query(_H + _A.format(f="arg_max") + _X)
def insert_update_new(spark, d):
    return N.insert_checked(*_halves(spark, d), mode="U")


@query(_H + "g as (select root, max(ord) as ord from c group by 1), z as (select entry, kv.key as field, kv.value as value from (select coalesce(g.root, m.ord) as entry, unnest(kvs) as kv from m left join g using (ord) where g.root is not null or (m.ord not in (select ord from c) and m.ord not in (select root from g)))) " + _X)
def insert_overwrite(spark, d):
    return N.insert_checked(*_halves(spark, d), mode="o")


@query(_H + f"z as (select case when ord >= {_N} then ord - {_N} else ord end as entry, unnest(kvs) as kv from m) select entry, kv.key as field, kv.value as value from z")
def insert_append(spark, d):
    return N.insert_checked(*_halves(spark, d), mode="a")


@query()
def insert_skip(spark, d):
    """The library with what no earlier record is a duplicate of (no SQL: a fixpoint; tests replay it record by record)."""
    return N.insert_checked(*_halves(spark, d), mode="s")


@query(f"""with s as (select rec_id + case when added_ts >= timestamp '2022-01-01' then {_N} else 0 end as ord, lib, lower(cite_key) as k, {fv('title')} as title from bib_entry where added_ts is not null and cite_key is not null),
f as (select *, min(ord) over (partition by lib, k) as first, arg_min(title, ord) over (partition by lib, k) as ft from s)
select ord - {_N} as rec_id, case when first >= {_N} then first - {_N} else first end as match, case when title = ft then 'duplicate' else 'conflict' end as kind from f where ord >= {_N} and first < ord""")
def insert_key_conflicts(spark, d):
    """Records of the batch whose key an earlier record of their library has."""
    return N.key_conflicts(*_halves(spark, d))


@query()
def dup_all(spark, d):
    """Groups of equal key, DOI or authors and title, first match first (no SQL: a fixpoint; tests replay it)."""
    return I.greedy_groups(bib(spark, d), by_key=True)


def _edited(spark, d) -> tuple[DataFrame, DataFrame]:
    """A library before and after: polarshared's records are retyped, those without a title go, others stay."""
    before = bib(spark, d)
    after = before.where(B.field("title") != "").withColumn("entry_type", F.when(F.col("lib") == "polarshared", "misc").otherwise(F.col("entry_type")))
    return before.where("rec_id is not null and (lib <> 'lib_kelemi' or lib is null)"), after


_E = f"""with b as (select * from bib_entry where lib <> 'lib_kelemi' or lib is null), a as (select * replace (case when lib = 'polarshared' then 'misc' else entry_type end as entry_type) from bib_entry where {fv('title')} <> '') """


@query(_E + "select rec_id, case when b.rec_id is null then 'added' when a.rec_id is null then 'removed' when coalesce(a.entry_type, '') <> coalesce(b.entry_type, '') then 'modified' else 'existing' end as change from b full join a using (rec_id)")
def biblio_diff(spark, d):
    return M.diff(*_edited(spark, d), key="rec_id")


@query(f"""select rec_id, array_to_string(list_concat(k, list_filter(['marked', 'ocean'], lambda x: not list_contains(k, x))), ', ') as keywords from (select rec_id, {KEYWORDS} as k from bib_entry)""")
def add_keyword(spark, d):
    b = bib(spark, d)
    k = B.keywords(B.field("keywords"))
    return b.select("rec_id", F.array_join(F.concat(k, F.array_except(F.array(F.lit("marked"), F.lit("ocean")), k)), ", ").alias("keywords"))


@query(f"select rec_id from bib_entry where not ({hasf('title')} and contains(lower({fv('title')}), 'kelp'))")
def delete_selected(spark, d):
    b = bib(spark, d)
    return b.join(S.select(b, S.by_field("title", ["kelp"])).select("rec_id"), "rec_id", "left_anti").select("rec_id")


_XMP = "concat_ws('', '<x>', case rec_id % 4 when 0 then '<pdfx:doi>10.1234/other</pdfx:doi>' when 1 then '<dc:identifier>urn:uuid:77</dc:identifier>' else '' end, '<dc:identifier>doi:' || lower(field_map['doi']) || '</dc:identifier>', case rec_id % 3 when 0 then '<CrossMark:doi>10.5555/third</CrossMark:doi>' else '' end)"


@query(f"""with t as (select rec_id, {_XMP} as x from bib_entry) select rec_id, coalesce({", ".join(f"nullif(regexp_extract(x, '(?i)<{a}>{p}(10[.][0-9]{{4,9}}/[-._;()/:a-z0-9]+)</{a}>', 1), '')" for a, p in (("prism:doi", ""), ("dc:identifier", "doi:"), ("pdfx:doi", ""), ("crossmark:DOI", "")))}) as doi from t""")
def metadata_doi(spark, d):
    """DOI of a metadata text, by the first place that holds one."""
    from ..operators import maintenance as U

    x = F.concat_ws(
        "", F.lit("<x>"), F.when(F.col("rec_id") % 4 == 0, "<pdfx:doi>10.1234/other</pdfx:doi>").when(F.col("rec_id") % 4 == 1, "<dc:identifier>urn:uuid:77</dc:identifier>").otherwise(""),
        F.concat(F.lit("<dc:identifier>doi:"), F.lower(F.col("field_map").getItem("doi")), F.lit("</dc:identifier>")), F.when(F.col("rec_id") % 3 == 0, "<CrossMark:doi>10.5555/third</CrossMark:doi>").otherwise(""),
    )
    return bib(spark, d).select("rec_id", U.metadata_doi(x).alias("doi"))


@query(f"select rec_id, array_to_string(list_transform({FAM}, lambda x: regexp_replace(x, '^[{{]((?:[^{{}}]|[{{](?:[^{{}}]|[{{](?:[^{{}}]|[{{][^{{}}]*[}}])*[}}])*[}}])*)[}}]$', '\\1', 's')), '|') as families from bib_entry")
def bare_families(spark, d):
    """Family names without the braces that enclose all of them."""
    return bib(spark, d).select("rec_id", F.array_join(F.transform(B.family_names(B.field("author")), B.strip_brackets), "|").alias("families"))


# --- identifiers and texts ------------------------------------------------------------------------------------
@query(f"select rec_id, {VDOI} as valid, not ({hasf('doi')}) as absent from bib_entry")
def doi_valid(spark, d):
    return bib(spark, d).select("rec_id", B.valid_doi(B.field("doi")).alias("valid"), (~B.has("doi")).alias("absent"))


@query()
def doi_of_documents(spark, d):
    """DOI of every document that has one, by all steps (no SQL: ordered preferences and cuts)."""
    return read(spark, d, "documents").select("doc_id", B.parse_doi(F.col("text")).alias("doi")).where("doi is not null")


@query(r"select doc_id, array_to_string(list_slice(w, 1, 200), ' ') as query from (select doc_id, list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda p: not starts_with(lower(p), 'reference')), ' '), '[\s\x0b]+'), lambda x: x <> '') as w from documents where text is not null) where len(w) >= 3")
def query_text(spark, d):
    t = read(spark, d, "documents").where("text is not null")
    return t.select("doc_id", B.query_text(F.col("text")).alias("query")).where("query is not null")


@query(r"select rec_id, case when b = '' then 'download' else replace(replace(url_decode(b), '/', '_'), '\', '_') end as name from (select rec_id, regexp_extract(regexp_replace(regexp_extract(field_map['link'], '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) as b from bib_entry where coalesce(field_map['link'], '') <> '')")
def url_basename(spark, d):
    return bib(spark, d).where(B.field("link") != "").select("rec_id", B.url_basename(B.field("link")).alias("name"))


@query("""with p as (select distinct file_id, page_no, txt from scanned_page where txt is not null), o as (select file_id, page_no, max(txt) as txt, row_number() over (partition by file_id order by page_no) - 1 as pos from p group by 1, 2),
w as (select file_id, page_no, pos, coalesce(sum(len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda x: x <> ''))) over (partition by file_id order by page_no rows between unbounded preceding and 1 preceding), 0) as before from o)
select file_id, page_no from w where before < 200 and pos < 10""")
def pdf_head(spark, d):
    """First pages of each file until 200 words or ten pages."""
    from pyspark.sql import Window

    p = read(spark, d, "scanned_page").where("txt is not null").groupBy("file_id", "page_no").agg(F.max("txt").alias("txt"))
    n = F.size(F.filter(F.split("txt", r"\s+"), lambda x: x != ""))
    w = Window.partitionBy("file_id").orderBy("page_no")
    # only ten pages of a file can count; the rank filter is applied before the shuffle
    o = p.select("file_id", "page_no", n.alias("n")).withColumn("pos", F.row_number().over(w)).where("pos <= 10")
    o = o.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return o.where("before < 200").select("file_id", "page_no")


# --- keys and files -------------------------------------------------------------------------------------------
@query()
def cite_keys(spark, d):
    """Keys from the template, unique within a library (no SQL: slugs of non-ASCII names)."""
    return K.cite_keys(bib(spark, d))


@query("select lib, cite_key, count(*) as n from bib_entry where cite_key is not null group by 1, 2 having count(*) > 1")
def key_clashes(spark, d):
    return bib(spark, d).where("cite_key is not null").groupBy("lib", "cite_key").agg(F.count("*").alias("n")).where("n > 1")


@query()
def rename_targets(spark, d):
    """Target path of every attachment under the file-name template (no SQL: slugs)."""
    return A.rename_targets(bib(spark, d), read(spark, d, "lib_file"))


_LIVE = "live as (select lib, file_path as path, min(sha256) as sha256, max(size_bytes) as size_bytes from lib_file where deleted_ts is null and file_path is not null group by 1, 2)"
_LINK = f"l as (select rec_id, lib, unnest({FILES}) as path, generate_subscripts({FILES}, 1)::bigint as pos from bib_entry where {fv('file')} <> '')"


@query(f"""with {_LINK}, {_LIVE}, j as (select l.*, sha256, live.path is not null as there, row_number() over (partition by rec_id, l.path order by pos) as p from l left join live on l.lib = live.lib and l.path = live.path),
k as (select *, p = 1 and there as ok from j), s as (select *, row_number() over (partition by rec_id, sha256, ok order by pos) as s from k)
select rec_id, pos, path, case when p > 1 then 'repeated_path' when not there then 'missing' when sha256 is not null and s > 1 then 'repeated_content' else 'keep' end as verdict from s""")
def filecheck(spark, d):
    return A.filecheck(bib(spark, d), read(spark, d, "lib_file"))


@query(f"""with {_LINK}, {_LIVE} select lib, path from live where not starts_with(string_split(path, '/')[-1], '.') and not ends_with(lower(path), '.bib') and not exists (select 1 from l where l.lib = live.lib and l.path = live.path)""")
def file_orphans(spark, d):
    return A.unreferenced(bib(spark, d), read(spark, d, "lib_file"))


@query(f"select lib, count(*) as n_entries, sum(len({FILES}))::bigint as n_files, sum((len({FILES}) > 0)::bigint)::bigint as n_with_file from bib_entry group by lib")
def library_status(spark, d):
    return A.status(bib(spark, d))


@query(f"with {_LIVE} select lib, count(*) as n_pdf, sum(size_bytes)::bigint as bytes from live where ends_with(lower(path), '.pdf') group by lib")
def file_sizes(spark, d):
    return A.sizes(read(spark, d, "lib_file"))


# --- history --------------------------------------------------------------------------------------------------
_VER = """with v as (select lib, version_no, min(kind) as kind, max(restores) as restores, min(ts) as ts from history_log where lib is not null and version_no is not null group by 1, 2),
c as (select lib, max(version_no) as head, arg_max(coalesce(restores, version_no), version_no) as cursor from v group by lib)"""


@query(_VER + """ select lib, head, cursor, (select version_no from v where v.lib = c.lib and version_no < cursor order by version_no desc limit 1) as undo_to,
(select version_no from v where v.lib = c.lib and version_no > cursor and restores is null order by version_no limit 1) as redo_to from c""")
def undo_redo_cursor(spark, d):
    return H.undo_redo(read(spark, d, "history_log"))


@query(_VER + """ select c.lib, head, cursor, b.version_no as undo_to, f.version_no as redo_to from c
left join (select lib, version_no from (select v.lib, version_no, row_number() over (partition by v.lib order by version_no desc) as r from v join c using (lib) where version_no < cursor) where r = 2) b on b.lib = c.lib
left join (select lib, version_no from (select v.lib, version_no, row_number() over (partition by v.lib order by version_no) as r from v join c using (lib) where version_no > cursor and restores is null) where r = 2) f on f.lib = c.lib""")
def undo_redo_two(spark, d):
    return H.undo_redo(read(spark, d, "history_log"), n=2)


@query(_VER + " select lib, count(*) as n_versions, sum((kind = 'restore')::bigint)::bigint as n_restores, max(ts) as last_ts from v group by lib")
def library_history(spark, d):
    return H.library_history(read(spark, d, "history_log"))


@query(_VER + " select c.lib, head + 1 as version_no, 'restore' as kind, 1::bigint as restores from c where exists (select 1 from v where v.lib = c.lib and v.version_no = 1)")
def restore_first(spark, d):
    log = read(spark, d, "history_log")
    return H.restore(log, H.versions(log).where("version_no = 1").select("lib", "version_no"))


# --- crossref -------------------------------------------------------------------------------------------------
@query("""select message_id, case json_extract_string(j, '$.type') when 'journal-article' then 'article' when 'book' then 'book' when 'book-chapter' then 'incollection' when 'proceedings-article' then 'inproceedings' when 'conference-paper' then 'inproceedings' when 'report' then 'techreport' when 'thesis' then 'phdthesis' else 'misc' end as entry_type,
coalesce(json_extract_string(j, '$.DOI'), '') as cite_key, coalesce(json_extract_string(j, '$.title[0]'), '') as title,
case when json_extract(j, '$."published-print"."date-parts"') is not null then coalesce(json_extract_string(j, '$."published-print"."date-parts"[0][0]'), '0000') when json_extract(j, '$."published-online"."date-parts"') is not null then coalesce(json_extract_string(j, '$."published-online"."date-parts"[0][0]'), '0000')
when json_extract(j, '$.issued."date-parts"') is not null then coalesce(json_extract_string(j, '$.issued."date-parts"[0][0]'), '0000') else '0000' end as year,
case when json_extract_string(j, '$.type') = 'journal-article' then coalesce(json_extract_string(j, '$."container-title"[0]'), '') else '' end as journal,
array_to_string(list_transform(coalesce(from_json(json_extract(j, '$.author'), '[{"family": "VARCHAR", "given": "VARCHAR"}]'), []), lambda a: case when coalesce(a.family, '') <> '' then a.family || ', ' || coalesce(a.given, '') else coalesce(a.given, '') end), ' and ') as author
from (select message_id, message_json::json as j from crossref_message where message_json is not null and json_valid(message_json))""")
def crossref_entries(spark, d):
    r = C.records(read(spark, d, "crossref_message"))
    return r.select("message_id", "entry_type", "cite_key", *[B.field(f).alias(f) for f in ("title", "year", "journal", "author")])


_P = "json_extract_string(j, '$.{}')".format
_IN = lambda kinds, x: f"case when t in ({kinds}) then {x} end"
_PEOPLE = """array_to_string(list_transform(coalesce(from_json(json_extract(j, '$.{}'), '[{{"family": "VARCHAR", "given": "VARCHAR"}}]'), []), lambda a: case when coalesce(a.family, '') <> '' then a.family || ', ' || coalesce(a.given, '') else coalesce(a.given, '') end), ' and ')""".format
_PARTS = """json_extract(j, '$."{0}"."date-parts"') is not null then coalesce(json_extract_string(j, '$."{0}"."date-parts"[0][0]'), '0000')""".format
_FETCHED = {
    "title": _P("title[0]"), "author": _PEOPLE("author"), "doi": _P("DOI"), "url": _P("URL"),
    "year": f"case when {_PARTS('published-print')} when {_PARTS('published-online')} when {_PARTS('issued')} else '0000' end",
    "journal": _IN("'journal-article'", _P('"container-title"[0]')), "volume": _IN("'journal-article'", _P("volume")), "number": _IN("'journal-article'", _P("issue")), "pages": _IN("'journal-article'", _P("page")),
    "publisher": _IN("'book', 'proceedings-article'", _P("publisher")), "address": _IN("'book'", _P('"publisher-location"')), "editor": _IN("'book', 'proceedings-article'", _PEOPLE("editor")), "isbn": _IN("'book'", _P("ISBN[0]")),
    "booktitle": _IN("'proceedings-article'", _P('"container-title"[0]')), "institution": _IN("'report'", _P("institution.name")), "school": _IN("'thesis'", _P("institution.name")), "type": _IN("'thesis'", _P("type")),
}


@query(
    f"""with q as (select lower(doi) as d, message_json::json as j, row_number() over (partition by lower(doi) order by fetched_ts desc nulls last, message_id desc) as r from crossref_message where coalesce(doi, '') <> '' and message_json is not null and json_valid(message_json)),
n as (select d, j, coalesce(json_extract_string(j, '$.type'), 'misc') as t from q where r = 1),
f as (select d, unnest([{", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in _FETCHED.items())}]) as x from n),
g as (select d, x.k as field, x.v as value from f where coalesce(x.v, '') <> ''),
b as (select rec_id, lower({fv('doi')}) as d, field_map from bib_entry),
o as (select rec_id, d, unnest(map_entries(field_map)) as kv from b)
select rec_id, field, value from b join g using (d) union all select rec_id, kv.key as field, kv.value as value from o where not exists (select 1 from g where g.d = o.d and g.field = o.kv.key)"""
)
def crossref_enrich(spark, d):
    """Fields of records after overlaying the newest message of their DOI."""
    return C.enrich(bib(spark, d), read(spark, d, "crossref_message"))


@query()
def crossref_rank(spark, d):
    """For every record whose rec_id is divisible by 50, the most relevant of all messages (no SQL: token-set ratios)."""
    b = bib(spark, d).where("rec_id % 50 = 0")
    m = C.records(read(spark, d, "crossref_message"))
    m = m.select("message_id", F.array_join(B.family_names(B.field("author")), " ").alias("author"), F.col("field_map").getItem("title").alias("title"), "abstract")
    return C.ranked(b.select("rec_id", F.concat_ws(" ", B.field("author"), B.field("title")).alias("text")), m, "rec_id")


@query("""with f as (select rec_id, lower(coalesce(field_map['doi'], '')) as d from bib_entry where coalesce(field_map['doi'], '') <> ''),
m as (select distinct lower(doi) as d from crossref_message where coalesce(doi, '') <> '') select rec_id, m.d is not null as known from f left join m using (d)""")
def doi_known(spark, d):
    m = read(spark, d, "crossref_message").where("doi is not null and doi <> ''").select(F.lower("doi").alias("d"), F.lit(True).alias("known")).distinct()
    f = bib(spark, d).select("rec_id", F.lower(B.field("doi")).alias("d")).where("d <> ''")
    return f.join(m, "d", "left").select("rec_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("""with q as (select doi, message_id, fetched_ts from crossref_message where coalesce(doi, '') <> '' and message_json is not null and json_valid(message_json))
select lower(doi) as doi_id, max((fetched_ts, message_id))[2] as message_id, substr(sha256(lower(doi)), 1, 6) as cache_key from q group by lower(doi)""")
def cache_lookup(spark, d):
    """Fetch cache: the newest message of each DOI, with its short hashed key."""
    return C.latest(read(spark, d, "crossref_message")).select("doi_id", "message_id", F.substring(F.sha2("doi_id", 256), 1, 6).alias("cache_key"))


# --- upkeep ---------------------------------------------------------------------------------------------------
@query("select lib, lower(cite_key) as key, max(rec_id) as rec_id from bib_entry where cite_key is not null group by 1, 2")
def key_lookup(spark, d):
    from ..operators import maintenance as U

    return U.lookup(bib(spark, d))


@query("select rec_id, row_number() over (partition by lib order by coalesce(cite_key, ''), rec_id) as place from bib_entry")
def library_order(spark, d):
    from ..operators.ordered import rank

    b = bib(spark, d).select("lib", F.coalesce("cite_key", F.lit("")).alias("key"), "rec_id")
    return rank(b, ["lib"], ["key", "rec_id"], "place").select("rec_id", "place")


@query()
def fix_entries(spark, d):
    """Names, DOI and key of every entry repaired in order (no SQL: ordered DOI preferences and slugs)."""
    from ..operators import maintenance as U

    return U.fix_entries(bib(spark, d))


@query()
def doi_mismatch(spark, d):
    """Documents whose text names another DOI than their record (no SQL: ordered DOI preferences)."""
    t = read(spark, d, "documents").where("rec_id is not null").select("doc_id", "rec_id", B.parse_doi(F.col("text")).alias("found")).where("found is not null")
    b = bib(spark, d).select("rec_id", F.lower(B.field("doi")).alias("known")).where("known <> ''")
    return t.join(b, "rec_id").where("lower(found) <> known").select("doc_id", "rec_id", "found", "known")


@query(f"""select rec_id, array_to_string(list_transform({FILES}, lambda p: coalesce(nullif(list_reduce(string_split(case when starts_with(p, '/') then p else '/srv/' || lib || '/' || p end, '/'), lambda a, x: case x when '' then a when '.' then a when '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end, ''), ''), '/')), '|') as paths from bib_entry where {fv('file')} <> ''""")
def normal_paths(spark, d):
    """Attachments as absolute, resolved paths under their library's root."""
    from ..operators import maintenance as U

    paths = U.rebase(B.attachments(B.field("file")), F.concat(F.lit("/srv/"), "lib"))
    return bib(spark, d).where(B.field("file") != "").select("rec_id", F.array_join(paths, "|").alias("paths"))


_J = f"""with b as (select rec_id, field_map['journal'] as old from bib_entry where {hasf('journal')}), a as (select rec_id, upper(field_map['journal']) as new from bib_entry where {hasf('journal')})"""


@query(_J + " select rec_id, 'journal' as field, old, new from a join b using (rec_id) where old <> new")
def field_changes(spark, d):
    b = bib(spark, d)
    a = b.withColumn("field_map", F.transform_values("field_map", lambda k, v: F.when(k == "journal", F.upper(v)).otherwise(v)))
    return M.field_diff(b, a, "rec_id").select("rec_id", "field", "old", "new")


@query(f"""with k as (select lower({fv('doi')}) as k, rec_id as v from bib_entry where {fv('doi')} <> ''), m as (select k, 'r' || max(v) as v from k group by k),
x as (select lower(doi) as k, 'm' || max(message_id) as v from crossref_message where coalesce(doi, '') <> '' group by 1) select k, coalesce(m.v, x.v) as v from m full join x using (k)""")
def cache_merge(spark, d):
    from ..operators import maintenance as U

    m = bib(spark, d).select(F.lower(B.field("doi")).alias("k"), "rec_id").where("k <> ''").groupBy("k").agg(F.concat(F.lit("r"), F.max("rec_id").cast("string")).alias("v"))
    x = read(spark, d, "crossref_message").where("doi is not null and doi <> ''").groupBy(F.lower("doi").alias("k")).agg(F.concat(F.lit("m"), F.max("message_id").cast("string")).alias("v"))
    return U.merge_cache(m, x, "k", "v")


@query(f"""with m as (select distinct group_no, rec_id from dup_link), s as (select group_no, rec_id, row_number() over (partition by group_no order by {SCORE} desc, rec_id desc) as r, group_no % 3 as a from m join bib_entry using (rec_id))
select group_no, rec_id, case when a = 2 then 'dropped' when r > 1 then 'dropped' when a = 0 then 'merged' else 'kept' end as fate from s""")
def group_fates(spark, d):
    """Fate of each confirmed duplicate under a decision by group number: merge, best, delete or none."""
    from ..operators import maintenance as U

    g = _members(spark, d)
    actions = F.element_at(F.array(F.lit("merge"), F.lit("best"), F.lit("delete")), (F.col("group_no") % 3 + 1).cast("int"))
    return U.decide(g, g.select("group_no").distinct().select("group_no", actions.alias("action")), "group_no")


@query("""with t as (select lib, coalesce(entry_type, '') || chr(29) || coalesce(cite_key, '') || chr(29) || coalesce(array_to_string(list_transform(list_sort(map_keys(field_map)), lambda k: k || chr(30) || coalesce(field_map[k], '')), chr(31)), '') as x from bib_entry),
h as (select lib, ('0x' || substr(sha256(x), 1, 15))::bigint as h from t) select lib, count(*) as n, bit_xor(h)::varchar || '-' || sum(h)::varchar as fingerprint from h group by lib""")
def library_fingerprints(spark, d):
    """Order-free content hash of every library."""
    from ..operators import maintenance as U

    return U.fingerprint(bib(spark, d))


@query("select type_in, case type_in when 'journal-article' then 'article' when 'book' then 'book' when 'book-chapter' then 'incollection' when 'proceedings-article' then 'inproceedings' when 'conference-paper' then 'inproceedings' when 'report' then 'techreport' when 'thesis' then 'phdthesis' else 'misc' end as type_out, count(*) as n from (select coalesce(json_extract_string(message_json::json, '$.type'), '') as type_in from crossref_message where message_json is not null and json_valid(message_json)) group by 1")
def crossref_types(spark, d):
    p = C.parsed(read(spark, d, "crossref_message"))
    return p.groupBy(F.coalesce("m.type", F.lit("")).alias("type_in")).agg(F.count("*").alias("n")).select("type_in", C.bib_type(F.col("type_in")).alias("type_out"), "n")


@query("select rec_id, row_number() over (partition by lib order by lower(coalesce(cite_key, '')), rec_id) as place from bib_entry")
def library_order_lower(spark, d):
    """Place of each record by key, letter case aside."""
    from ..operators.ordered import rank

    b = bib(spark, d).select("lib", F.lower(F.coalesce("cite_key", F.lit(""))).alias("key"), "rec_id")
    return rank(b, ["lib"], ["key", "rec_id"], "place").select("rec_id", "place")


@query(_E + """, s as (select coalesce(a.rec_id, b.rec_id) as rec_id, coalesce(a.cite_key, b.cite_key) as k, a.rec_id is not null and b.rec_id is not null and coalesce(a.entry_type, '') = coalesce(b.entry_type, '') as same from b full join a using (rec_id)),
t as (select distinct k from s where not same and k is not null) select rec_id, k in (select k from t) as touched from s where k is not null""")
def touched_keys(spark, d):
    """Records split by whether an edit touched their key."""
    return M.touched(*_edited(spark, d), key="rec_id", name="cite_key")


@query(f"select rec_id from bib_entry where rec_id is not null and not ({SQL['list_review_required'].split(' where ', 1)[1]})")
def list_reviewed(spark, d):
    """Records that need no review."""
    return S.select(bib(spark, d), ~S.needs_review()).select("rec_id")


@query("""select min(rec_id) as first, count(*) as copies from bib_entry group by coalesce(entry_type, ''),
array_to_string(list_transform(list_sort(list_filter(map_keys(field_map), lambda x: x not in ('file', 'keywords'))), lambda x: x || chr(30) || field_map[x]), chr(31))""")
def exact_unique_but(spark, d):
    """One row for each different content, key, attachments and keywords aside."""
    return I.exact_unique(bib(spark, d), skip=("ID", "file", "keywords"))


@query(f"""with m as (select distinct group_no, rec_id from dup_link), l as (select group_no, rec_id, lib, unnest({FILES}) as path, generate_subscripts({FILES}, 1) as pos from m join bib_entry using (rec_id)), {_LIVE},
p as (select group_no, path, min((rec_id, pos, lib)) as x from l group by 1, 2), c as (select group_no, p.path, x, coalesce('#' || sha256, '/' || p.path) as what from p left join live on live.lib = x[3] and live.path = p.path),
f as (select group_no, what, min((x, path)) as y from c group by 1, 2) select group_no, row_number() over (partition by group_no order by y) as place, y[2] as path from f""")
def merge_files_by_content(spark, d):
    """Attachments of a group, each path and each content once."""
    return A.merged(_members(spark, d), read(spark, d, "lib_file"), "group_no")


@query(_VER + """, o as (select lib, version_no as kept from (select lib, version_no, row_number() over (partition by lib order by version_no desc) as r from v) where r = 3)
select v.lib, v.version_no from v join o on o.lib = v.lib join c on c.lib = v.lib where v.version_no < kept and v.version_no <> c.cursor""")
def versions_beyond(spark, d):
    """Versions that go when each library keeps its newest three."""
    return H.beyond(read(spark, d, "history_log"), 3)
