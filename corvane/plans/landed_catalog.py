"""Queries over landed tables, commits, external samples and made sources, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import answers, prompts, scoring
from corvane.functions import text as T
from corvane.operators import landed, nodes, quality, relational
from corvane.plans.catalog import _CAT_SQL, _STRIPPED_SQL, _VALID, _docs, _labelled, _query, _t

_HOME_SQL = "case page_id % 4 when 0 then url else 'none' end"
_LINK_SQL = "coalesce(case when contains(lower(home), 'http') then home end, case when code <> '' then code end, repo)"


@_query(f"""with k as (select page_id, {_HOME_SQL} home, case when page_id % 3 = 0 then url || '?c' when page_id % 3 = 1 then '' end code, case when page_id % 5 = 0 then url || '?r' end repo, case when page_id % 2 = 0 then 'log' || page_id else '' end changes from pages order by page_id limit 500)
 select page_id, {_LINK_SQL} github_link, nullif(changes, '') changelog_url, case when contains({_LINK_SQL}, '?c') then 'Java' when contains({_LINK_SQL}, 'http') then 'Python' end lang from k where {_LINK_SQL} is not null""")
def package_links(spark, sf):
    """The first 500 packages: home page, else a named link; the changelog; the language by the link."""
    p, u = F.col("page_id"), F.col("url")
    urls = F.create_map(
        F.lit("Repository"), F.when(p % 5 == 0, F.concat(u, F.lit("?r"))), F.lit("Code"), F.when(p % 3 == 0, F.concat(u, F.lit("?c"))).when(p % 3 == 1, ""),
        F.lit("Other"), u, F.lit("Changes"), F.when(p % 2 == 0, F.concat(F.lit("log"), p)).otherwise(""),
    )
    index = landed.first_packages(_t(spark, sf, "pages").select("page_id", F.when(p % 4 == 0, u).otherwise("none").alias("home_page"), urls.alias("project_urls")), p)
    found = landed.package_links(index, marker="http")
    return found.select("page_id", "github_link", "changelog_url", landed.language_by_url(F.col("github_link"), {"?c": "Java", "http": "Python"}).alias("lang"))


@_query("select page_id, 'main' branch from pages where page_id % 4 = 0 and page_id % 3 <> 0")
def landed_metadata(spark, sf):
    """Pages whose lookup answered 200, without those that lack a branch."""
    pages = _t(spark, sf, "pages").select("page_id")
    asked = pages.where("page_id % 2 = 0").select("page_id", F.when(F.col("page_id") % 4 == 0, 200).otherwise(404).alias("status"), F.when(F.col("page_id") % 3 == 0, "").otherwise("main").alias("branch"))
    return landed.complete(landed.looked_up(pages, asked, "page_id"), "branch").select("page_id", "branch")


def _commits(spark, sf):
    e = _t(spark, sf, "events")
    i = F.col("event_id")
    commits = e.select(F.col("user_id").alias("repo_id"), i.alias("sha"), "ts", F.concat(F.col("event_type"), F.lit(" of the parser number "), i).alias("message"))
    file = lambda n, patch: F.struct(F.concat(F.lit(f"f{n}_"), i % 3, F.lit(".py")).alias("filename"), patch.alias("patch"))
    patch = F.when(i % 2 == 0, F.format_string("@@ -1,2 +%d,%d @@ x", i % 9 + 1, i % 4)).otherwise(F.lit(None).cast("string"))
    details = e.select(F.col("user_id").alias("repo_id"), i.alias("sha"), F.when(i % 7 == 0, 404).otherwise(200).alias("status"), F.array(file(0, patch), file(1, F.lit(""))).alias("files"))
    return commits, details


_NEWEST_SQL = "(select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 300)"


@_query(f"select user_id repo_id, event_id sha, 'f' || n || '_' || event_id % 3 || '.py' filename, len(regexp_extract_all(event_type || ' of the parser number ' || event_id, '{{TOK}}'))::bigint doc_token_count, case when n = 0 and event_id % 2 = 0 then 5 else 0 end::bigint patch_token_count, 'Python' as lang, case when n = 0 and event_id % 2 = 0 then 'medium' else 'low' end confidence from {_NEWEST_SQL}, (select unnest([0, 1]) n) where event_id % 7 <> 0")
def commit_rows(spark, sf):
    """The newest commits of each repository, their details, one row a file."""
    out = landed.commit_rows(landed.commit_files(*_commits(spark, sf)))
    return out.select("repo_id", "sha", "filename", "doc_token_count", "patch_token_count", F.col("language").alias("lang"), F.col("alignment_confidence").alias("confidence"))


@_query(f"""with c as (select user_id repo_id, event_id sha, 'f0_' || event_id % 3 || '.py' filename, event_id % 9 + 1 a, event_id % 9 + event_id % 4 b, event_type || ' of the parser number ' || event_id t from {_NEWEST_SQL} where event_id % 7 <> 0 and event_id % 2 = 0),
 p as (select *, (not (b < 1 or a > 3))::int + (not (b < 4 or a > 6))::int + (not (b < 4 or a > 12))::int k from c)
 select repo_id, sha, sha256('commit_message|' || repo_id || '|' || filename || '|' || sha) uid, case when k = 1 then 'high' else 'medium' end confidence, t as text from p where k > 0""")
def commit_pairs(spark, sf):
    """Commits with the named nodes that their patches touch: x (1-3), y (4-6), z (4-12)."""
    rows = landed.commit_rows(landed.commit_files(*_commits(spark, sf)))
    place = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("start"), F.lit(e).alias("end")) for n, s, e in (("x", 1, 3), ("y", 4, 6), ("z", 4, 12)))))
    files = rows.where("filename like 'f0%'").select("repo_id", "filename").distinct().select("repo_id", "filename", place.alias("n")).select("repo_id", "filename", "n.*")
    return landed.commit_pairs(rows, files, ["repo_id", "filename"]).select("repo_id", "sha", "uid", "confidence", "text")


_CSN_SQL = "select 'csn-{0}-' || (row_number() over (order by item_id) - 1) uid, 'unknown' repo_id, 'b' || item_id || '.x' file_path, '{1}' \"language\", 'docstring' source, 'function' entity_type, 'high' confidence, text, 'code ' || item_id code from (select * from benchmark where item_id % 2 = {2} order by item_id limit 15)"
_EXTERNAL_SQL = f"({_CSN_SQL.format('python', 'Python', 0)} union all {_CSN_SQL.format('java', 'Java', 1)})"


def _external(spark, sf):
    b = _t(spark, sf, "benchmark").select("item_id", "text", F.concat(F.lit("b"), F.col("item_id"), F.lit(".x")).alias("file_path"), F.concat(F.lit("code "), F.col("item_id")).alias("code"), F.lit(None).cast("string").alias("repo_id"))
    return landed.external_sample(b.where("item_id % 2 = 0"), "python", F.col("item_id"), 15).unionByName(landed.external_sample(b.where("item_id % 2 = 1"), "java", F.col("item_id"), 15))


@_query(f"select * from {_EXTERNAL_SQL}")
def external_samples(spark, sf):
    """The first rows of two external tables, in the columns of our pairs."""
    return _external(spark, sf)


def _categories(spark, sf):
    entity = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, "function").otherwise("class")).when(F.col("doc_id") % 3 == 0, "function").when(F.col("doc_id") % 3 == 1, "any")
    source = F.when(F.col("quality") == 1, "docstring").when(F.col("doc_id") % 3 == 1, "commit_message").otherwise("inline_comment")
    return _labelled(spark, sf).select("doc_id", "lang", scoring.category(source, entity).alias("category")).where("category is not null")


_BUCKET_SQL = f"(select d.doc_id, d.lang, {_CAT_SQL} category from documents d left join labels l on d.doc_id = l.doc_id where {_CAT_SQL} is not null)"


@_query(f"with k as {_BUCKET_SQL}, n as (select category, lang, count(*) n from k group by 1, 2), q as (select *, floor(90.0 / count(*) over (partition by category))::bigint quota from n) select category, lang, n, quota, least(n, quota) taken from q")
def bucket_report(spark, sf):
    return landed.bucket_report(_categories(spark, sf), "category", "lang", {c: 90 for c in scoring.QUOTAS})


@_query(f"""with k as {_BUCKET_SQL}, n as (select category, count(distinct lang) langs from k group by 1), q as (select 'd' || doc_id uid, k.category source from k join n on k.category = n.category qualify row_number() over (partition by k.category, lang order by md5(doc_id || '|42'), doc_id) <= floor(40.0 / any_value(langs) over (partition by k.category)))
 select uid, source from q union all select uid, source from (select uid, source from {_EXTERNAL_SQL} order by md5(uid || '|42'), uid limit 20)""")
def training_sample(spark, sf):
    """The quota sample, and beside it at most 20 external rows."""
    quota = relational.quota_sample(_categories(spark, sf), "category", "lang", F.col("doc_id"), {c: 40 for c in scoring.QUOTAS})
    own = quota.select(F.concat(F.lit("d"), F.col("doc_id")).alias("uid"), F.col("category").alias("source"))
    return landed.with_external(own, _external(spark, sf).select("uid", "source", "language"), n=20).select("uid", "source")


@_query("with r as (select doc_id, length(text) n, row_number() over (order by length(text), doc_id) - 1 i, count(*) over () c from documents) select doc_id, n, i // 8 batch from r where i < c - c % 8")
def global_length_batches(spark, sf):
    """Batches of 8 over the whole table in the order of length."""
    rows = _docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("n"))
    return landed.global_batches(rows, 8, F.col("n"), "doc_id")


@_query("select doc_id, length(text) n_chars, length(text) // 4 about from documents where length(text) <= 800 or len(regexp_extract_all(text, '{TOK}')) <= 200")
def token_budget(spark, sf):
    found = landed.within_budget(_docs(spark, sf), F.col("text"), 800, 200)
    out = found.select("doc_id", F.length("text").cast("long").alias("n_chars"), T.about_tokens(F.col("text")).alias("about"), F.lit(1).alias("_idx"))
    return landed.without_private(out)


@_query("select doc_id, md5(array_to_string(regexp_extract_all(text, '{TOK}')[1:40], ' ')) head_md5 from documents")
def truncated_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.truncate_tokens(F.col("text"), 40).cast("binary")).alias("head_md5"))


@_query(f"select source, count(*) filter ({_VALID.format('text')}) n_kept, count(*) filter (not {_VALID.format('text')}) n_skipped from documents group by 1")
def kept_skipped(spark, sf):
    return landed.outcome(_docs(spark, sf), T.has_words(F.col("text")), "source")


_LF2 = "chr(10) || chr(10)"
_USER_SQL = f"'Code:' || chr(10) || 'c' || doc_id || {_LF2} || 'Documentation:' || chr(10) || {_STRIPPED_SQL} || {_LF2} || 'Question:' || chr(10) || 'q' || {_LF2} || "


@_query(f"""select doc_id, md5('Write one question that a reader of this code would ask, and answer it from the code and its documentation.' || {_LF2} || 'Documentation:' || chr(10) || {_STRIPPED_SQL} || {_LF2} || 'Code:' || chr(10) || 'c' || doc_id || {_LF2} || 'Return ONLY JSON: reasoning, question, answer.') ask,
 md5({_USER_SQL} 'Draft answer:' || chr(10) || 'd' || {_LF2} || 'Improve the draft: be correct, direct and short.') improve, md5({_USER_SQL} 'Answer:') predict, md5({_USER_SQL} 'Answer directly and technically.') draft from documents""")
def request_templates(spark, sf):
    code, doc, question = F.concat(F.lit("c"), F.col("doc_id")), F.col("text"), F.lit(" q ")
    made = {"ask": prompts.question_request(doc, code), "improve": prompts.improve_request(code, doc, question, F.lit(" d")), "predict": prompts.predict_request(code, doc, question), "draft": prompts.user_request(code, doc, question)}
    return _docs(spark, sf).select("doc_id", *(F.md5(c.cast("binary")).alias(n) for n, c in made.items()))


_SPACED_SQL = "lower(trim(regexp_replace(replace(replace(replace({0}, '“', '\"'), '”', '\"'), '’', chr(39)), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')))"
_CUT_SQL = "string_split(string_split(string_split(string_split({0}, 'Question:')[1], 'Code:')[1], 'Documentation:')[1], 'Answer:')[1]"


def _said(x: str) -> str:
    return _SPACED_SQL.format(_CUT_SQL.format(x))


@_query(f"""with p as (select doc_id, doc_id % 9 k, 'So ' || text t, 'so ' || substr(text, 1 + length(text) // 2) half from documents)
 select doc_id, case k when 0 then true when 1 then true when 2 then false when 3 then true when 4 then false when 5 then true when 6 then doc_id % 2 = 0
 when 7 then contains({_said("t")}, {_said("substr(t, 1, length(t) // 2)")}) else contains({_said("t")}, {_said("half")}) end matches from p""")
def answers_match_pairs(spark, sf):
    """Pairs that differ: numbers, lists, truth values, quoted strings, and whole texts against their halves."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 9
    text = F.concat(F.lit("So "), F.col("text"))
    half = F.concat(F.lit("so "), F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1))
    pred = (
        F.when(k == 0, i).when(k == 1, F.concat(F.lit("the value is "), i, F.lit(" Code: x"))).when(k == 2, i).when(k == 3, F.concat(F.lit("[2, 1, "), i, F.lit("]")))
        .when(k == 4, F.concat(F.lit("[1, "), i, F.lit("]"))).when(k == 5, "True").when(k == 6, F.concat(F.lit("'a"), i, F.lit("'"))).otherwise(text)
    )
    twice = (F.col("doc_id") * 2 + 7).cast("string")
    gold = (
        F.when(k == 0, F.concat(i, F.lit(".0000000"))).when(k == 1, i).when(k == 2, twice).when(k == 3, F.concat(F.lit("["), i, F.lit(",1,2]"))).when(k == 4, F.concat(F.lit("[1, "), twice, F.lit("]")))
        .when(k == 5, "1").when(k == 6, F.concat(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("b"), i)).when(k == 7, F.substr(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(half)
    )
    return _docs(spark, sf).select("doc_id", answers.answers_match(pred, gold).alias("matches"))


# --- sources made of every document ------------------------------------------


def _made_sources(spark, sf):
    """A Python or a Java file of each document: a class with a method, the whole text as a comment."""
    d, i = _docs(spark, sf), F.col("doc_id").cast("string")
    line = F.regexp_replace("text", r"[\s\x0b\x1c-\x1f\x85  ]+", " ")
    py = F.concat(F.lit("class C"), i, F.lit(':\n    """Doc of the item '), i, F.lit('"""\n    def f(self):\n        """Does f."""\n        return 1\n    def _g(self):\n        pass\n# '), line, F.lit("\n"))
    java = F.concat(F.lit("/** Doc of the item "), i, F.lit(" */\n@Ok\npublic class C"), i, F.lit(" {\n    // so "), line, F.lit("\n    enum E { A }\n    /** Far. */\n\n    private int f(int x) {\n        return x;\n    }\n}\n"))
    even = F.col("doc_id") % 2 == 0
    return d.select("doc_id", F.when(even, "Python").otherwise("Java").alias("language"), F.when(even, py).otherwise(java).alias("text"))


_LINE_SQL = r"regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{2028}\x{2029}]+', ' ', 'g')"
_COMMENT_SQL = f"case when doc_id % 2 = 0 then trim(ltrim(' ' || {_LINE_SQL}, '#')) else trim('so ' || {_LINE_SQL}) end"


@_query(f"""select doc_id, 'class' entity_type, 'C' || doc_id entity_name, case when doc_id % 2 = 0 then 'docstring' else 'javadoc' end source_type, md5('Doc of the item ' || doc_id) doc_md5, 5::bigint doc_token_count, case when doc_id % 2 = 0 then 2 else 1 end doc_start_line, case when doc_id % 2 = 0 then 1 else 2 end entity_start_line, case when doc_id % 2 = 0 then 7 else 11 end entity_end_line, 'high' confidence from documents
 union all select doc_id, 'function', 'f', 'docstring', md5('Does f.'), 2, 4, 3, 5, 'high' from documents where doc_id % 2 = 0
 union all select doc_id, 'comment', null, 'inline_comment', md5({_COMMENT_SQL}), len(regexp_extract_all(text, '{{TOK}}')) + doc_id % 2, case when doc_id % 2 = 0 then 8 else 4 end, case when doc_id % 2 = 0 then 8 else 4 end, case when doc_id % 2 = 0 then 8 else 4 end, case when doc_id % 2 = 0 then 'medium' else 'high' end from documents""")
def source_entities(spark, sf):
    """Documented entities and comments of every made file; a doc comment two lines above is not its."""
    e = nodes.entities(_made_sources(spark, sf), ["doc_id"])
    return e.select("doc_id", "entity_type", "entity_name", "source_type", F.md5(F.col("doc_text").cast("binary")).alias("doc_md5"), "doc_token_count", "doc_start_line", "entity_start_line", "entity_end_line", F.col("alignment_confidence").alias("confidence"))


@_query("""select doc_id, unnest(case when doc_id % 2 = 0 then ['C' || doc_id, 'f', '_g'] else ['C' || doc_id, 'f'] end) as name, unnest(case when doc_id % 2 = 0 then ['class', 'function', 'function'] else ['class', 'function'] end) as type, unnest(case when doc_id % 2 = 0 then [1, 3, 6] else [2, 8] end) as "start", unnest(case when doc_id % 2 = 0 then [7, 5, 7] else [11, 10] end) as "end", unnest(case when doc_id % 2 = 0 then [true, true, false] else [true, false] end) is_public from documents""")
def source_nodes(spark, sf):
    """Nodes of every made file: the enum of the Java files is none."""
    return nodes.code_nodes(_made_sources(spark, sf)).select("doc_id", "name", "type", "start", "end", "is_public")


@_query("select doc_id, case when doc_id % 2 = 0 then 2 else 1 end::bigint total_functions, case when doc_id % 2 = 0 then 1 else 2 end::bigint total_classes, 1::bigint documented_classes, case when doc_id % 2 = 0 then 1 else 0 end::bigint documented_functions from documents")
def source_counters(spark, sf):
    m = nodes.file_metrics(_made_sources(spark, sf), ["doc_id"])
    return m.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("total_functions", "total_classes", "documented_classes", "documented_functions")))


@_query("select source repo_id, round(avg((doc_id % 3 <> 0)::int::double), 6) core_density from documents group by 1")
def core_density(spark, sf):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "docs/").otherwise("src/"), F.col("doc_id"), F.lit(".py"))
    out = quality.core_density(_docs(spark, sf).select(F.col("source").alias("repo_id"), path.alias("file_path")))
    return out.select("repo_id", F.round("core_density", 6).alias("core_density"))


@_query(f"select user_id repo_id, event_id commit_sha, case when event_id % 2 = 0 then 'p' || event_id end parent_sha, 'f_' || event_id % 3 || '.py' file_path, 'changed_file' entity_type, 'Python' as lang, len(regexp_extract_all(event_type || ' of the parser', '{{TOK}}'))::bigint doc_token_count, 'modified' change_status, (event_id % 9)::int additions, (event_id % 4)::int deletions, 'medium' confidence from {_NEWEST_SQL}")
def commit_entities(spark, sf):
    """Rows of changed files with parents, status and counts of lines."""
    e, i = _t(spark, sf, "events"), F.col("event_id")
    commits = e.select(F.col("user_id").alias("repo_id"), i.alias("sha"), "ts", F.concat(F.col("event_type"), F.lit(" of the parser")).alias("message"))
    file = F.struct(F.concat(F.lit("f_"), i % 3, F.lit(".py")).alias("filename"), F.lit("@@ -1 +1 @@").alias("patch"), F.lit("modified").alias("status"), (i % 9).cast("int").alias("additions"), (i % 4).cast("int").alias("deletions"))
    parents = F.when(i % 2 == 0, F.array(F.concat(F.lit("p"), i))).otherwise(F.array().cast("array<string>"))
    details = e.select(F.col("user_id").alias("repo_id"), i.alias("sha"), F.lit(200).alias("status"), parents.alias("parents"), F.array(file).alias("files"))
    out = landed.commit_entities(landed.commit_files(commits, details))
    return out.select("repo_id", "commit_sha", "parent_sha", "file_path", "entity_type", F.col("language").alias("lang"), "doc_token_count", "change_status", "additions", "deletions", F.col("alignment_confidence").alias("confidence"))
