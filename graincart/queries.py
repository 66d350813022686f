"""The engine's operators as queries over the test tables, each with the SQL that it is compared with.

A query is (session, folder of tables) -> DataFrame. The SQL states the same result on its own, for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graincart.functions import rewards as R
from graincart.functions import text as X
from graincart.functions.hashing import hash_split, is_holdout, stable_fraction, stable_hex
from graincart.operators import manifests as M
from graincart.operators import metrics as E
from graincart.operators import reports as P
from graincart.operators import sampling as S
from graincart.operators.schema import ROLES, SPLITS, TASK_TYPES, VERIFIER_MODES, with_violations
from graincart.plans import build as B
from graincart.plans import normalize as N
from graincart.plans.evaluate import run_task

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- SQL of the functions

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _lower(x: str) -> str:
    # DuckDB drops the dot of the dotted capital I
    return f"lower(replace(coalesce({x}, ''), 'İ', 'i̇'))"


def _ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def _edges(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def _nt(x: str) -> str:
    return f"trim(regexp_replace({_lower(x)}, '[^a-z0-9:/_-]+', ' ', 'g'))"


def _nl(x: str) -> str:
    return f"trim(regexp_replace({_lower(x)}, '[^a-z0-9:-]+', ' ', 'g'))"


def _split_name(x: str) -> str:
    return f"CASE WHEN {_nl(x)} IN ('val', 'valid') THEN 'validation' ELSE {_nl(x)} END"


def _words(x: str) -> str:
    return f"len(list_filter(string_split({_ws(x)}, ' '), lambda w: w <> ''))"


def _fraction(value: str, salt: str) -> str:
    return f"(('0x' || substr(sha256('{salt}::' || {value}), 1, 12))::BIGINT / 281474976710656::DOUBLE)"


def _strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _contains_any(x: str, phrases: str) -> str:
    return f"len(list_filter({phrases}, lambda p: {_nt('p')} <> '' AND contains({_nt(x)}, {_nt('p')}))) > 0"


def _best_match(refs: str, x: str) -> str:
    return f"CASE WHEN len(list_filter({refs}, lambda r: {_nt('r')} = {_nt(x)})) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE"


def _decision(x: str) -> str:
    return f"CASE WHEN contains(coalesce({x}, ''), '?') OR {_contains_any(x, _strings(X.CLARIFY_MARKERS))} THEN 'clarify' ELSE 'respond' END"


def _overlap(terms: str, x: str) -> str:
    names = f"list_distinct(list_filter(list_transform(coalesce({terms}, []), lambda t: {_nl('t')}), lambda t: t <> ''))"
    tokens = f"string_split({_nt(x)}, ' ')"
    hit = f"len(list_filter(string_split({_nt('t')}, ' '), lambda w: w <> '' AND NOT list_contains({tokens}, w))) = 0 AND {_nt('t')} <> ''"
    return f"CASE WHEN len({names}) > 0 THEN len(list_filter({names}, lambda t: {hit})) / len({names})::DOUBLE ELSE 0.0 END"


def _group_key(t: str = "") -> str:
    return f"coalesce({t}source_dataset, 'None') || '::' || coalesce(nullif(json_extract_string({t}metadata, '$.source_image_id'), ''), {t}images[1], '')"


# ---------------------------------------------------------------- text and labels


@query(f"SELECT doc_id, sha256({_nt('text')}) AS norm_hash, sha256({_ws('text')}) AS ws_hash, {_words('text')}::INTEGER AS words FROM documents")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.sha2(X.normalize_text("text"), 256).alias("norm_hash"), F.sha2(X.normalize_whitespace("text"), 256).alias("ws_hash"), X.word_count("text").alias("words"))


@query(f"SELECT ord, {_nl('target.canonical_label')} AS label, replace({_nl('images[1]')}, ' ', '-') AS slug FROM manifest")
def label_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "manifest").select("ord", X.normalize_label("target.canonical_label").alias("label"), X.slugify(F.get("images", F.lit(0))).alias("slug"))


_LABEL = "CASE p_size % 3 WHEN 0 THEN p_brand || '___' || replace(p_name, ' ', '_') WHEN 1 THEN p_type || '__' || p_name ELSE p_name || '-' || p_type END"


@query(
    f"WITH p AS (SELECT p_partkey, {_LABEL} AS l FROM part) SELECT p_partkey, "
    f"CASE WHEN contains(l, '___') THEN {_ws("replace(substr(l, 1, instr(l, '___') - 1), '_', ' ')")} WHEN contains(l, '__') THEN {_ws("replace(substr(l, 1, instr(l, '__') - 1), '_', ' ')")} END AS crop, "
    f"CASE WHEN contains(l, '___') THEN {_ws("replace(substr(l, instr(l, '___') + 3), '_', ' ')")} WHEN contains(l, '__') THEN {_ws("replace(substr(l, instr(l, '__') + 2), '_', ' ')")} ELSE {_ws("replace(l, '_', ' ')")} END AS disease, "
    f"{_ws("translate(l, '_-', '  ')")} AS pest FROM p"
)
def parse_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").withColumn("l", F.expr(_LABEL))
    plant = X.parse_plant_label("l")
    return rows.select("p_partkey", plant["crop"].alias("crop"), plant["disease"].alias("disease"), X.parse_pest_label("l").alias("pest"))


@query(f"SELECT ord, round({_overlap('verifier.management_keywords', 'target.answer_text')}, 6) AS overlap FROM manifest")
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "manifest").select("ord", F.round(X.overlap_ratio(F.col("verifier.management_keywords"), "target.answer_text"), 6).alias("overlap"))


@query(f"SELECT run_name, sample_id, {_best_match('acceptable_answers', 'prediction')} AS best, CASE WHEN {_nt('reference_text')} = {_nt('prediction')} THEN 1.0 ELSE 0.0 END::DOUBLE AS exact FROM predictions")
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "predictions").select("run_name", "sample_id", X.best_exact_match(F.col("acceptable_answers"), "prediction").alias("best"), X.exact_match("reference_text", "prediction").alias("exact"))


@query(
    f"SELECT run_name, sample_id, {_contains_any('prediction', _strings(R.UNCERTAINTY_MARKERS))} AS uncertain, {_contains_any('prediction', _strings(R.OVERCONFIDENT_MARKERS))} AS overconfident, "
    f"len(list_filter({_strings(X.SECTIONS)}, lambda h: contains({_nt('prediction')}, {_nt("h || ':'")})))::INTEGER AS sections, {_decision('prediction')} AS decision FROM predictions"
)
def answer_markers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "predictions").select(
        "run_name", "sample_id", X.contains_any("prediction", R.UNCERTAINTY_MARKERS).alias("uncertain"), X.contains_any("prediction", R.OVERCONFIDENT_MARKERS).alias("overconfident"),
        F.size(X.section_headers_present("prediction", X.SECTIONS)).alias("sections"), X.infer_decision("prediction").alias("decision"),
    )


@query(
    f"WITH m AS (SELECT ord, split, 'data/' || split || '/' || images[1] AS path FROM manifest) SELECT ord, {_split_name('split')} AS split_name, "
    f"CASE WHEN lower({_ws('split')}) IN ('val', 'valid') THEN 'validation' ELSE lower({_ws('split')}) END AS raw_split, "
    f"list_filter(list_transform(string_split(path, '/'), lambda p: {_split_name('p')}), lambda p: p IN ('train', 'validation', 'test', 'dev'))[1] AS path_split FROM m"
)
def split_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "manifest")
    path = F.concat(F.lit("data/"), F.col("split"), F.lit("/"), F.get("images", F.lit(0)))
    return rows.select("ord", X.normalize_split_name("split").alias("split_name"), X.canonical_split("split").alias("raw_split"), X.detect_split_from_path(path).alias("path_split"))


_QUESTIONS = " ".join(f"WHEN task_type = '{t}' THEN '{q}'" for t, q in X.DEFAULT_QUESTIONS.items() if t)


@query(f"SELECT ord, CASE {_QUESTIONS} ELSE '{X.DEFAULT_QUESTIONS['']}' END AS by_task, CASE WHEN coalesce(target.answer_text, '') <> '' THEN {_ws('target.answer_text')} ELSE CASE {_QUESTIONS} ELSE '{X.DEFAULT_QUESTIONS['']}' END END AS stated FROM manifest")
def default_questions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "manifest").select("ord", X.user_question("task_type", F.lit(None).cast("string")).alias("by_task"), X.user_question("task_type", "target.answer_text").alias("stated"))


@query(
    "WITH m AS (SELECT ord, json_extract_string(target.structured, '$.diagnosis') AS d, list_filter(list_transform(coalesce(TRY_CAST(json_extract(target.structured, '$.management_steps') AS VARCHAR[]), []), lambda s: "
    f"{_edges('s')}), lambda s: s <> '') AS steps FROM manifest WHERE target.structured IS NOT NULL) "
    f"SELECT ord, 'Diagnosis: ' || coalesce(d, '') || chr(10) || 'Evidence: {X.EVIDENCE_LINE}' || chr(10) || 'Uncertainty: {X.UNCERTAINTY_LINE}' || chr(10) || 'Management: ' || CASE WHEN len(steps) > 0 THEN array_to_string(steps, '; ') ELSE '{X.NO_STEPS_LINE}' END || chr(10) || 'Follow-up: {X.FOLLOW_UP_LINE}' AS answer FROM m"
)
def structured_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "manifest").where("target.structured IS NOT NULL")
    made = F.from_json("target.structured", "diagnosis string, management_steps array<string>")
    return rows.select("ord", X.structured_answer(F.coalesce(made["diagnosis"], F.lit("")), made["management_steps"], F.lit(X.UNCERTAINTY_LINE)).alias("answer"))


_RAW_DECISION = f"regexp_replace({_lower(_edges("json_extract_string(p, '$.decision')"))}, '^[<>]+|[<>]+$', '', 'g')"
_PAYLOAD = "SELECT record_id, source_dataset, CASE WHEN json_valid(payload) THEN payload END AS p FROM raw_records"


@query(
    f"WITH r AS ({_PAYLOAD}), d AS (SELECT record_id, {_RAW_DECISION} AS d FROM r) SELECT record_id, CASE WHEN d = '' THEN NULL WHEN contains(d, 'respond') THEN 'respond' "
    "WHEN contains(d, 'clarify') OR contains(d, 'more info') OR contains(d, 'ask') THEN 'clarify' ELSE d END AS decision FROM d"
)
def decision_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = N.parsed(read(spark, folder, "raw_records"))
    return rows.select("record_id", X.normalize_decision(N.text_of(N.pick("decision"))).alias("decision"))


# ---------------------------------------------------------------- hashes, quotas, samples


@query(
    f"SELECT ord, {_fraction('sample_id', 'demo')} AS fraction, CASE WHEN {_fraction('sample_id', 'demo')} < 0.8::DOUBLE THEN 'train' WHEN {_fraction('sample_id', 'demo')} < 0.9::DOUBLE THEN 'validation' ELSE 'test' END AS hashed, "
    f"{_fraction('sample_id', 'held')} < 0.1::DOUBLE AS held FROM manifest"
)
def hash_splits(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("sample_id")
    return read(spark, folder, "manifest").select("ord", stable_fraction(key, "demo").alias("fraction"), hash_split(key, "demo").alias("hashed"), is_holdout(key, "held", 0.1).alias("held"))


@query(f"SELECT ord, {_group_key()} AS group_key FROM manifest")
def group_keys(spark: SparkSession, folder: str) -> DataFrame:
    return M.with_group(read(spark, folder, "manifest")).select("ord", "group_key")


@query("SELECT split, ord FROM (SELECT split, ord, row_number() OVER (PARTITION BY split ORDER BY ord) AS k, count(*) OVER (PARTITION BY split) AS n FROM manifest) WHERE k <= greatest(1, floor(n * 0.1::DOUBLE))")
def prefix_quota(spark: SparkSession, folder: str) -> DataFrame:
    return S.prefix_quota(read(spark, folder, "manifest").select("split", "ord"), "split", 0.1).select("split", "ord")


@query("SELECT source_dataset, ord FROM (SELECT source_dataset, ord, row_number() OVER (PARTITION BY source_dataset ORDER BY ord) AS k FROM manifest) WHERE k <= 25")
def first_n_per_source(spark: SparkSession, folder: str) -> DataFrame:
    return S.first_n(read(spark, folder, "manifest").select("source_dataset", "ord"), "source_dataset", 25)


@query("SELECT doc_id, sha256('shuffle::' || doc_id::VARCHAR) AS order_key FROM documents ORDER BY 2, 1 LIMIT 50")
def hash_shuffle_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.hash_shuffled(read(spark, folder, "documents").select("doc_id"), "shuffle", "doc_id").limit(50)
    return rows.select("doc_id", stable_hex(F.col("doc_id"), "shuffle").alias("order_key"))


_SAMPLE, _FLOOR = 150, 5
_FIRST = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS k FROM manifest) WHERE k = 1"


@query(
    f"""WITH r AS (SELECT * FROM ({_FIRST}) WHERE split IN ('validation', 'dev')),
s AS (SELECT source_dataset AS a, task_type AS b, split AS c, count(*) AS n, min(ord) AS seen FROM r GROUP BY ALL),
t AS (SELECT *, least({_FLOOR}, n, greatest({_SAMPLE} - coalesce(sum(least({_FLOOR}, n)) OVER (ORDER BY n DESC, seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS t1 FROM s),
u AS (SELECT *, n - t1 AS cap, {_SAMPLE} - sum(t1) OVER () AS rem, sum(n - t1) OVER () AS tot FROM t),
v AS (SELECT *, CASE WHEN rem > 0 AND cap > 0 THEN rem::DOUBLE * cap::DOUBLE / tot::DOUBLE ELSE 0::DOUBLE END AS raw FROM u),
w AS (SELECT *, least(cap, floor(raw)) AS t2 FROM v),
x AS (SELECT *, cap - t2 AS spare, rem - sum(t2) OVER () AS rest FROM w),
y AS (SELECT *, t1 + t2 + CASE WHEN spare > 0 AND row_number() OVER (ORDER BY spare > 0 DESC, raw - t2 DESC, spare DESC, a DESC, b DESC, c DESC) <= rest THEN 1 ELSE 0 END AS alloc FROM x),
z AS (SELECT sample_id, alloc, row_number() OVER (PARTITION BY a, b, c ORDER BY sha256('strata::(''' || a || ''', ''' || b || ''', ''' || c || ''')::' || sample_id), ord) AS k FROM r JOIN y ON source_dataset = a AND task_type = b AND split = c)
SELECT r.sample_id, sha256('strata::' || r.sample_id) AS order_key FROM r LEFT JOIN z ON r.sample_id = z.sample_id WHERE (SELECT count(*) FROM r) <= {_SAMPLE} OR z.k <= z.alloc"""
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = _first_rows(read(spark, folder, "manifest")).where(F.col("split").isin("validation", "dev")).select("ord", "sample_id", *B.STRATA)
    return S.stratified_sample(rows, _SAMPLE, list(B.STRATA), _FLOOR, "strata").select("sample_id", "order_key")


def _first_rows(manifest: DataFrame) -> DataFrame:
    """The first delivery of each record."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("ord"))
    return manifest.withColumn("_k", rank).where("_k = 1").drop("_k")


_PLACE = "l_linenumber::BIGINT * 100000000 + l_partkey"


@query(
    f"WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min({_PLACE}) AS first FROM lineitem GROUP BY ALL) "
    "SELECT l_orderkey, l_returnflag AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, l_returnflag DESC) AS k FROM c) WHERE k = 1"
)
def mode_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Line numbers repeat within an order, so the part tells its lines apart."""
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", F.expr(_PLACE).alias("place"))
    return S.mode_first_seen(rows, ["l_orderkey"], "l_returnflag", "place").select("l_orderkey", "mode", "n")


# ---------------------------------------------------------------- merges, filters, joins

_NAMED = f"named AS (SELECT * REPLACE (lower({_ws('source_dataset')}) AS source_dataset) FROM manifest)"


def _registered_sql(flag: str) -> str:
    return f"{_NAMED}, sources AS (SELECT lower({_ws('source_dataset')}) AS source_dataset, row_number() OVER () - 1 AS source_ord FROM dataset_registry WHERE {flag})"


def _named(manifest: DataFrame) -> DataFrame:
    """`manifest` under the canonical names of its sources, which compare trimmed and in lower case."""
    return manifest.withColumn("source_dataset", X.name_key("source_dataset"))


def _registered(spark: SparkSession, folder: str, flag: str) -> list[str]:
    """The names of the registry's sources with `flag`, in its order."""
    return [r.name for r in read(spark, folder, "dataset_registry").where(flag).select(X.name_key("source_dataset").alias("name")).collect()]


def _sources(manifest: DataFrame, names: list[str]) -> list[DataFrame]:
    return [manifest.where(F.col("source_dataset") == n) for n in names]


@query(
    f"WITH {_registered_sql('include_in_sft')} SELECT source_ord::INTEGER AS source_ord, ord, sample_id FROM named JOIN sources USING (source_dataset) "
    f"WHERE task_type IN {_in(B.SFT_TASKS)} AND coalesce(split, '') <> 'test'"
)
def merge_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The merge of every source that the registry has for it, however its name is written, without a cap."""
    sources = _sources(_named(read(spark, folder, "manifest")), _registered(spark, folder, "include_in_sft"))
    return B.build_sft(sources).select("source_ord", "ord", "sample_id")


@query(
    f"WITH {_registered_sql('include_in_rl')} SELECT source_ord::INTEGER AS source_ord, ord FROM named JOIN sources USING (source_dataset) WHERE task_type IN {_in(B.RL_TASKS)} AND coalesce(split, '') <> 'test' "
    f"AND verifier.mode IN {_in(B.RL_MODES)} AND len(coalesce(images, [])) <= 1 AND {_words("coalesce(nullif(target.answer_text, ''), target.canonical_label)")} <= 80"
)
def rewardable_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The build from every source that the registry has for it, however its name is written."""
    sources = _sources(_named(read(spark, folder, "manifest")), _registered(spark, folder, "include_in_rl"))
    return B.build_rl(sources).select("source_ord", "ord")


#: The sources of the local holdout; a benchmark has tracks of its own.
_HOLDS = "include_in_eval AND task_family <> 'eval'"
_WHOLE = f"WITH {_NAMED}, sources AS (SELECT lower({_ws('source_dataset')}) AS source_dataset FROM dataset_registry WHERE {_HOLDS})"
_HELD = f"SELECT * REPLACE ('holdout' AS split) FROM named WHERE source_dataset IN (SELECT source_dataset FROM sources) AND coalesce(split, '') <> 'test' AND {_fraction(_group_key(), 'eval')} < 0.1::DOUBLE"
_POOL = f"""held AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord DESC) AS k FROM ({_HELD}) WHERE len(images) <= 1),
more AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS k FROM named WHERE split IN ('validation', 'dev') AND len(images) <= 1 AND sample_id NOT IN (SELECT sample_id FROM held)),
pool AS (SELECT * FROM held WHERE k = 1 UNION ALL SELECT * FROM more WHERE k = 1)"""
_REASON = f"""marked AS (SELECT ord, source_dataset, CASE WHEN len(coalesce(images, [])) > 1 THEN 'max_images' WHEN split <> 'train' THEN 'split'
WHEN sample_id IN (SELECT sample_id FROM pool) OR {_group_key()} IN (SELECT {_group_key()} FROM pool) THEN 'eval_overlap' END AS reason FROM named)"""


def _whole(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The manifest under the canonical names of its sources, which pictures are grouped and hashed by, and its holdout."""
    rows = _named(read(spark, folder, "manifest"))
    held = M.with_group(rows.where(F.col("source_dataset").isin(*_registered(spark, folder, _HOLDS))))
    return rows, S.holdout(held, F.col("group_key"), "eval", 0.1).drop("group_key")


def _pool(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows, held = _whole(spark, folder)
    return rows, M.eval_pool(held, rows, ("validation", "dev"), 1)


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    rows, pool = _pool(spark, folder)
    return M.train_rows(rows, pool, ("train",), 1)


@query(f"{_WHOLE} SELECT ord, sample_id FROM ({_HELD})")
def holdout_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(spark, folder)[1].select("ord", "sample_id")


@query(f"{_WHOLE}, {_POOL} SELECT sample_id, ord, split FROM pool")
def eval_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _pool(spark, folder)[1].select("sample_id", "ord", "split")


@query(f"{_WHOLE}, {_POOL}, {_REASON} SELECT ord, reason FROM marked")
def leak_safe_train(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("ord", "reason")


@query(f"{_WHOLE}, {_POOL}, {_REASON} SELECT source_dataset, coalesce(reason, 'train') AS reason, count(*) AS n FROM marked GROUP BY ALL")
def rejection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).groupBy("source_dataset", F.coalesce("reason", F.lit("train")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH a AS (SELECT * FROM manifest WHERE split = 'train'), b AS (SELECT * FROM manifest WHERE split IN ('validation', 'dev', 'holdout')) "
    f"SELECT (SELECT count(*) FROM (SELECT sample_id FROM a INTERSECT SELECT sample_id FROM b)) AS exact_sample_id, (SELECT count(*) FROM (SELECT {_group_key()} FROM a INTERSECT SELECT {_group_key()} FROM b)) AS group_key"
)
def overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "manifest")
    return M.overlap_counts(rows.where("split = 'train'"), rows.where("split IN ('validation', 'dev', 'holdout')"))


@query("SELECT ord, CASE WHEN contains(lower(coalesce(json_extract_string(metadata, '$.benchmark_track'), '')), 'mmmt') OR task_type = 'clarify_or_respond' THEN 'mmmt' ELSE 'mmst' END AS track FROM manifest WHERE " + f"lower({_ws('source_dataset')}) = 'mirage'")
def route_tracks(spark: SparkSession, folder: str) -> DataFrame:
    return M.route_tracks(_named(read(spark, folder, "manifest")).where("source_dataset = 'mirage'")).select("ord", "track")


@query("SELECT s_suppkey, coalesce(n_name, 'unlisted') AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON s_nationkey = n_nationkey")
def class_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup of class names with a default."""
    classes = read(spark, folder, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    labelled = N.with_labels(read(spark, folder, "supplier"), classes.withColumnRenamed("n_name", "label"), "s_nationkey")
    return labelled.select("s_suppkey", F.coalesce("label", F.lit("unlisted")).alias("label"))


_STRUCTURED = "CASE WHEN regexp_replace(coalesce(target.structured, ''), '\\s', '', 'g') NOT IN ('', '{}', 'null') THEN target.structured END"
_TARGET = (
    "coalesce(nullif(target.answer_text, ''), nullif(target.canonical_label, ''), CASE WHEN len(target.canonical_labels) > 0 THEN array_to_string(target.canonical_labels, ', ') END, "
    f"'{{\"content\": ' || ({_STRUCTURED}) || ', \"decision\": \"' || nullif(target.decision, '') || '\"}}', nullif(target.decision, ''), {_STRUCTURED}, target.acceptable_answers[1])"
)


@query(f"SELECT ord, {_TARGET} AS target_text FROM manifest")
def target_texts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "manifest").select("ord", M.target_text(F.col("target")).alias("target_text"))


@query(
    f"SELECT ord, len(messages)::INTEGER + 1 AS turns, {_TARGET} AS last_text, len(list_filter(messages, lambda m: m.role <> 'assistant'))::INTEGER AS prompt_turns, "
    "array_to_string(list_transform(list_filter(flatten(list_transform(messages, lambda m: m.content)), lambda p: p.text IS NOT NULL), lambda p: p.text), '|') AS prompt_text FROM manifest"
)
def chat_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "manifest")
    asked = M.prompt_messages(rows)
    text = F.array_join(F.transform(F.filter(F.flatten(F.transform("messages", lambda m: m["content"])), lambda p: p["text"].isNotNull()), lambda p: p["text"]), "|")
    prompts = asked.select("ord", F.size("messages").alias("prompt_turns"), text.alias("prompt_text"))
    last = F.element_at("messages", -1)
    return M.training_messages(rows).select("ord", F.size("messages").alias("turns"), last["content"][0]["text"].alias("last_text")).join(prompts, "ord")


@query(
    "SELECT sample_id, task_type, len(list_filter(messages, lambda m: m.role <> 'assistant'))::INTEGER AS prompt_turns, target.answer_text AS answer_text, verifier.mode AS mode, "
    "reward_meta.structured_output_required AS structured, len(images)::INTEGER AS images FROM manifest"
)
def rl_records(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON columns, read again."""
    rows = M.rl_records(read(spark, folder, "manifest"))
    return rows.select(
        "sample_id", "task_type", F.json_array_length("prompt").alias("prompt_turns"), F.get_json_object("target_json", "$.answer_text").alias("answer_text"), F.get_json_object("verifier_json", "$.mode").alias("mode"),
        F.get_json_object("reward_meta_json", "$.structured_output_required").cast("boolean").alias("structured"), F.json_array_length("images_json").alias("images"),
    )


# ---------------------------------------------------------------- counts and reports


@query(
    "SELECT CASE WHEN grouping(source_dataset) = 0 THEN 'source_dataset' WHEN grouping(task_type) = 0 THEN 'task_type' ELSE 'split' END AS field, coalesce(source_dataset, task_type, split) AS value, count(*) AS n "
    "FROM manifest GROUP BY GROUPING SETS ((source_dataset), (task_type), (split))"
)
def summary_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return P.summarize(read(spark, folder, "manifest"))


@query("SELECT coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return P.value_counts(read(spark, folder, "documents"), "lang")


@query("SELECT len(coalesce(images, []))::INTEGER AS images, count(*) AS n FROM manifest GROUP BY ALL")
def image_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return P.image_histogram(read(spark, folder, "manifest"))


@query("SELECT image, min(ord) AS first_ord FROM (SELECT ord, unnest(images) AS image FROM manifest) GROUP BY image")
def unique_images(spark: SparkSession, folder: str) -> DataFrame:
    return P.unique_images(read(spark, folder, "manifest"))


_CHECKED = "SELECT image_path AS image, CASE WHEN min(n_bytes) IS NULL THEN 'missing file' WHEN bool_and(content_sha IS NULL) THEN 'no digest' END AS error FROM image_index GROUP BY image_path"


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    error = F.when(F.min("n_bytes").isNull(), "missing file").when(F.bool_and(F.col("content_sha").isNull()), "no digest")
    return read(spark, folder, "image_index").groupBy(F.col("image_path").alias("image")).agg(error.alias("error"))


@query(
    f"WITH c AS ({_CHECKED}), e AS (SELECT ord, count(*) AS bad FROM (SELECT ord, unnest(images) AS image FROM manifest) JOIN c USING (image) WHERE error IS NOT NULL GROUP BY ord), "
    "m AS (SELECT source_dataset, len(coalesce(images, [])) AS shown, coalesce(bad, 0) AS bad FROM manifest LEFT JOIN e USING (ord)) "
    "SELECT coalesce(nullif(source_dataset, ''), 'unknown') AS source_dataset, count(*) AS rows, count(*) FILTER (WHERE bad > 0 OR shown = 0) AS invalid_rows, sum(shown)::BIGINT AS images, sum(bad)::BIGINT AS invalid_images FROM m GROUP BY ALL"
)
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.validation_summary(P.image_errors(read(spark, folder, "manifest"), _checked(spark, folder)))


@query(
    f"WITH c AS ({_CHECKED}) SELECT ord, error, count(*) AS n FROM (SELECT ord, unnest(images) AS image FROM manifest) JOIN c USING (image) WHERE error IS NOT NULL GROUP BY ALL"
)
def invalid_rows(spark: SparkSession, folder: str) -> DataFrame:
    marked = P.image_errors(read(spark, folder, "manifest"), _checked(spark, folder))
    return marked.select("ord", F.explode("errors").alias("e")).groupBy("ord", F.col("e.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH n AS (SELECT lower({_ws('source_dataset')}) AS name, count(*) AS rows FROM manifest GROUP BY ALL), d AS (SELECT lower({_ws('source_dataset')}) AS name, bool_and(coalesce(json_valid(payload), false)) AS manual FROM raw_records GROUP BY ALL) "
    "SELECT source_dataset, task_family, coalesce(rows, 0) AS normalized_rows, CASE WHEN rows IS NOT NULL THEN 'normalized' WHEN manual THEN 'manual_required' WHEN manual IS NOT NULL THEN 'downloaded_only' ELSE 'missing' END AS status "
    f"FROM (SELECT *, lower({_ws('source_dataset')}) AS name FROM dataset_registry) LEFT JOIN n USING (name) LEFT JOIN d USING (name)"
)
def dataset_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the manifest counts, whatever its split, its task and the spelling of its source."""
    name = X.name_key("source_dataset").alias("source_dataset")
    rows = read(spark, folder, "manifest").groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
    downloads = read(spark, folder, "raw_records").groupBy(name).agg(F.bool_and(F.try_parse_json("payload").isNotNull()).alias("manual_required"))
    return P.dataset_report(_named(read(spark, folder, "dataset_registry")), rows, downloads)


def _readiness(registry: DataFrame) -> DataFrame:
    paths = registry.select(
        F.col("task_family").alias("name"), F.when(F.col("task_family") == "eval", "planned").otherwise("implemented").alias("implementation_status"), F.col("source_dataset").alias("path"),
        F.col("include_in_eval").alias("required"), F.col("_there").isNotNull().alias("exists"),
    )
    return P.readiness(paths)


_PATHS = f"SELECT task_family AS name, CASE task_family WHEN 'eval' THEN 'planned' ELSE 'implemented' END AS implementation_status, lower({_ws('source_dataset')}) AS path, include_in_eval AS required, lower({_ws('source_dataset')}) IN (SELECT lower({_ws('source_dataset')}) FROM manifest) AS found FROM dataset_registry"


@query(
    f"WITH p AS ({_PATHS}) SELECT name, implementation_status, CASE WHEN implementation_status <> 'implemented' THEN 'planned_or_blocked' WHEN count(*) FILTER (WHERE required AND NOT found) = 0 THEN 'ready' ELSE 'missing_data' END AS readiness_status, "
    "count(*) FILTER (WHERE required AND NOT found) AS missing, coalesce(string_agg(DISTINCT path, '<br>' ORDER BY path) FILTER (WHERE required AND NOT found), '') AS missing_paths FROM p GROUP BY name, implementation_status"
)
def readiness_status(spark: SparkSession, folder: str) -> DataFrame:
    """A data set with any row in the manifest is there."""
    there = _named(read(spark, folder, "manifest")).select("source_dataset").distinct().withColumn("_there", F.lit(True))
    return _readiness(_named(read(spark, folder, "dataset_registry")).join(there, "source_dataset", "left"))


@query(
    "SELECT event_type, count(*)::DOUBLE AS metric_events, round(max(value), 6) AS metric_highest, round(sum(value), 2) AS metric_total FROM events GROUP BY event_type"
)
def metric_pivot(spark: SparkSession, folder: str) -> DataFrame:
    measures = F.create_map(F.lit("events"), F.count(F.lit(1)).cast("double"), F.lit("highest"), F.round(F.max("value"), 6), F.lit("total"), F.round(F.sum("value"), 2))
    tasks = read(spark, folder, "events").groupBy("event_type").agg(measures.alias("metrics"))
    return P.pivot_metrics(tasks, ["event_type"], ["events", "highest", "total"])


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, props FROM events) WHERE json_type(json_extract(props, '$.' || key)) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND key <> 'global_step' GROUP BY key")
def numeric_keys(spark: SparkSession, folder: str) -> DataFrame:
    return P.numeric_keys(read(spark, folder, "events"), "props")


def _bad_part(p: str) -> str:
    return f"coalesce({p}.type, '') NOT IN ('text', 'image') OR ({p}.type = 'text' AND coalesce({p}.text, '') = '') OR ({p}.type = 'image' AND coalesce({p}.image, '') = '')"


_RULES = [
    ("sample_id", f"{_edges('sample_id')} = ''"),
    ("source_dataset", f"{_edges('source_dataset')} = ''"),
    ("task_type", f"coalesce(task_type, '') NOT IN {_in(TASK_TYPES)}"),
    ("split", f"coalesce(split, '') NOT IN {_in(SPLITS)}"),
    ("images_empty", "coalesce(len(images), 0) < 1"),
    ("images_blank", "len(list_filter(images, lambda i: coalesce(i, '') = '')) > 0"),
    ("messages_empty", "coalesce(len(messages), 0) < 1"),
    ("role", f"len(list_filter(messages, lambda m: coalesce(m.role, '') NOT IN {_in(ROLES)})) > 0"),
    ("content_empty", "len(list_filter(messages, lambda m: coalesce(len(m.content), 0) < 1)) > 0"),
    ("content", f"len(list_filter(flatten(list_transform(messages, lambda m: m.content)), lambda p: {_bad_part('p')})) > 0"),
    ("target_empty", f"NOT (coalesce(target.answer_text, '') <> '' OR coalesce(target.canonical_label, '') <> '' OR coalesce(len(target.canonical_labels), 0) > 0 OR coalesce(target.decision, '') <> '' OR ({_STRUCTURED}) IS NOT NULL OR coalesce(len(target.acceptable_answers), 0) > 0)"),
    ("decision", "target.decision NOT IN ('clarify', 'respond')"),
    ("verifier_mode", f"verifier.mode NOT IN {_in(VERIFIER_MODES)}"),
    ("expected_decision", "verifier.expected_decision NOT IN ('clarify', 'respond')"),
]


@query("SELECT ord, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in _RULES) + "], lambda c: c IS NOT NULL), ',') AS violations FROM manifest")
def row_violations(spark: SparkSession, folder: str) -> DataFrame:
    return with_violations(read(spark, folder, "manifest")).select("ord", F.array_join("violations", ",").alias("violations"))


# ---------------------------------------------------------------- rewards and metrics


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions beside the verifier of their record's first delivery. The manifest's side is pruned to what rewards read."""
    records = _first_rows(read(spark, folder, "manifest").select("ord", "sample_id", "target", "verifier", "reward_meta")).drop("ord")
    return read(spark, folder, "predictions").select("run_name", "sample_id", "prediction").join(records, "sample_id")


_SCORED = f"s AS (SELECT p.run_name, p.sample_id, coalesce(p.prediction, '') AS said, m.target AS t, m.verifier AS v, m.reward_meta AS r FROM predictions p JOIN ({_FIRST}) m ON p.sample_id = m.sample_id)"
_ACCEPTABLE = "list_concat(list_concat(coalesce(t.acceptable_answers, []), coalesce(v.accepted_answers, [])), CASE WHEN coalesce(t.answer_text, '') <> '' THEN [t.answer_text] ELSE [] END)"
_LABELS = "list_filter(list_concat(coalesce(t.canonical_labels, []), [t.canonical_label]), lambda l: coalesce(l, '') <> '')"
_TERMS = "flatten(list_transform(map_entries(v.synonyms), lambda e: list_concat([e.key], coalesce(e.value, []))))"
_REWARD_SQL = {
    "exact_match": _best_match(_ACCEPTABLE, "said"),
    "normalized_label": f"CASE WHEN len(list_filter({_LABELS}, lambda l: {_nl('l')} = {_nl('said')})) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "synonym_match": f"CASE WHEN coalesce(len(list_filter({_TERMS}, lambda x: contains({_nl('said')}, {_nl('x')}))), 0) > 0 OR (coalesce(t.canonical_label, '') <> '' AND {_nt('t.canonical_label')} <> '' AND contains({_nt(_nl('said'))}, {_nt('t.canonical_label')})) THEN 1.0 ELSE 0.0 END::DOUBLE",
    "structured_format": f"CASE WHEN len(v.required_sections) > 0 THEN len(list_filter(v.required_sections, lambda h: contains({_nt('said')}, {_nt("h || ':'")}))) / len(v.required_sections)::DOUBLE ELSE 0.0 END",
    "uncertainty_calibration": f"CASE WHEN v.uncertainty_required AND {_contains_any('said', _strings(R.UNCERTAINTY_MARKERS))} THEN 1.0 ELSE 0.0 END::DOUBLE",
    "clarify_vs_respond": f"CASE WHEN coalesce(nullif(t.decision, ''), nullif(v.expected_decision, '')) = ({_decision('said')}) THEN 1.0 ELSE 0.0 END::DOUBLE",
    "management_coverage": _overlap("v.management_keywords", "said"),
    "hallucination_penalty": f"(CASE WHEN {_contains_any('said', 'coalesce(v.forbidden_claims, [])')} THEN -1.0 ELSE 0.0 END + CASE WHEN v.uncertainty_required AND {_contains_any('said', _strings(R.OVERCONFIDENT_MARKERS))} THEN -0.5 ELSE 0.0 END)::DOUBLE",
}


def _reward(name: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = _scored(spark, folder)
        x = R.RewardInput.of(F.col("prediction"), F.col("target"), F.col("verifier"), F.col("reward_meta"))
        return rows.select("run_name", "sample_id", F.round(R.REWARDS[name](x), 6).alias("reward"))

    run.__name__ = f"reward_{name}"
    query(f"WITH {_SCORED} SELECT run_name, sample_id, round({_REWARD_SQL[name]}, 6) AS reward FROM s")(run)


for _name in R.REWARDS:
    _reward(_name)

_TOTAL = " + ".join(f"({_REWARD_SQL[n]}) * {w}::DOUBLE" for n, w in R.TRAINING_WEIGHTS.items())
_OWN_TOTAL = " + ".join(f"({_REWARD_SQL[n]}) * coalesce(r.weights['{n}'], 1.0::DOUBLE)" for n in R.EVALUATION_MODULES)


@query(f"WITH {_SCORED} SELECT run_name, sample_id, round({_TOTAL}, 6) AS training, round({_OWN_TOTAL}, 6) AS evaluation FROM s")
def reward_composite(spark: SparkSession, folder: str) -> DataFrame:
    x = R.RewardInput.of(F.col("prediction"), F.col("target"), F.col("verifier"), F.col("reward_meta"))
    training, evaluation = R.composite(x, R.TRAINING_WEIGHTS, R.TRAINING_WEIGHTS)["total"], R.composite(x, R.EVALUATION_MODULES)["total"]
    return _scored(spark, folder).select("run_name", "sample_id", F.round(training, 6).alias("training"), F.round(evaluation, 6).alias("evaluation"))


_HAS_DECISION = "coalesce(decision, '') <> ''"


def _decision_sql(expected: str, said: str, has: str) -> str:
    tp, fp, fn, tn = (f"(count(*) FILTER (WHERE {has} AND {a} AND {b}))::DOUBLE" for a, b in ((expected, said), (f"NOT ({expected})", said), (expected, f"NOT ({said})"), (f"NOT ({expected})", f"NOT ({said})")))

    def ratio(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN round(({part}) / ({whole}), 6) ELSE 0.0 END"

    total = f"({tp} + {fp} + {fn} + {tn})"
    values = {
        "clarify_accuracy": ratio(f"{tp} + {tn}", total), "clarify_precision": ratio(tp, f"({tp} + {fp})"), "clarify_recall": ratio(tp, f"({tp} + {fn})"), "unnecessary_clarification_rate": ratio(fp, f"({fp} + {tn})"),
        "premature_answer_rate": ratio(fn, f"({tp} + {fn})"), "predicted_clarify_rate": ratio(f"{tp} + {fp}", total), "expected_clarify_rate": ratio(f"{tp} + {fn}", total),
    }
    return ", ".join(f"CASE WHEN {tp} + {fp} + {fn} + {tn} > 0 THEN {v} END AS {n}" for n, v in values.items())


def _f1_sql(rows: str, ref: str, said: str) -> str:
    return (
        f"l AS (SELECT run_name, {_nl(ref)} AS a, {_nl(said)} AS b FROM {rows} WHERE coalesce({ref}, '') <> ''), c AS (SELECT run_name, a AS label, (a = b)::INT AS tp, 0 AS fp, (a <> b)::INT AS fn FROM l UNION ALL SELECT run_name, b, 0, 1, 0 FROM l WHERE a <> b), "
        "g AS (SELECT run_name, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY ALL), f AS (SELECT run_name, avg(CASE WHEN tp > 0 THEN tp * 2.0::DOUBLE / (tp * 2 + fp + fn) ELSE 0.0 END) AS label_macro_f1 FROM g GROUP BY run_name)"
    )


def _rounded(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


@query(f"SELECT run_name, CASE WHEN count(*) FILTER (WHERE coalesce(canonical_label, '') <> '') > 0 THEN round((count(*) FILTER (WHERE coalesce(canonical_label, '') <> '' AND {_nl('canonical_label')} = {_nl('prediction')})) / (count(*) FILTER (WHERE coalesce(canonical_label, '') <> ''))::DOUBLE, 6) ELSE 0.0 END AS label_accuracy FROM predictions GROUP BY run_name")
def label_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    has = F.coalesce(F.col("canonical_label"), F.lit("")) != ""
    return read(spark, folder, "predictions").groupBy("run_name").agg(F.round(E.accuracy(F.col("canonical_label"), F.col("prediction"), has), 6).alias("label_accuracy"))


@query(f"WITH {_f1_sql('predictions', 'canonical_label', 'prediction')} SELECT run_name, round(label_macro_f1, 6) AS label_macro_f1 FROM f")
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "predictions").where("coalesce(canonical_label, '') <> ''")
    return _rounded(E.macro_f1(rows, "canonical_label", "prediction", ["run_name"]), ("run_name",))


@query("SELECT run_name, " + _decision_sql("decision = 'clarify'", f"({_decision('prediction')}) = 'clarify'", _HAS_DECISION) + " FROM predictions GROUP BY run_name")
def clarify_confusion(spark: SparkSession, folder: str) -> DataFrame:
    has = F.coalesce(F.col("decision"), F.lit("")) != ""
    some = F.count_if(has) > 0
    metrics = E.decision_metrics(F.col("decision"), F.col("prediction"), has)
    return read(spark, folder, "predictions").groupBy("run_name").agg(*[F.when(some, F.round(c, 6)).alias(n) for n, c in metrics.items()])


_AVG_REWARD = f"round(avg({_OWN_TOTAL}), 6)"


@query(
    f"WITH {_SCORED}, {_f1_sql('(SELECT run_name, said, t.canonical_label AS ref FROM s)', 'ref', 'said')}, b AS (SELECT run_name, count(*) AS num_examples, "
    f"CASE WHEN count(*) FILTER (WHERE coalesce(t.canonical_label, '') <> '') > 0 THEN round((count(*) FILTER (WHERE coalesce(t.canonical_label, '') <> '' AND {_nl('t.canonical_label')} = {_nl('said')})) / (count(*) FILTER (WHERE coalesce(t.canonical_label, '') <> ''))::DOUBLE, 6) ELSE 0.0 END AS label_accuracy, "
    f"round(coalesce(avg(CASE WHEN coalesce(t.answer_text, '') <> '' THEN {_best_match('CASE WHEN len(t.acceptable_answers) > 0 THEN t.acceptable_answers ELSE [t.answer_text] END', 'said')} END), 0.0), 6) AS answer_exact_match, {_AVG_REWARD} AS average_reward, "
    + _decision_sql("t.decision = 'clarify'", f"({_decision('said')}) = 'clarify'", "coalesce(t.decision, '') <> ''")
    + " FROM s GROUP BY run_name) SELECT b.*, round(coalesce(label_macro_f1, 0.0), 6) AS label_macro_f1 FROM b LEFT JOIN f USING (run_name)"
)
def eval_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(E.local_bundle(_scored(spark, folder), ["run_name"]), ("run_name",))


@query(
    f"WITH {_SCORED} SELECT run_name, count(*) AS num_examples, round(coalesce(avg({_best_match("CASE WHEN len(t.acceptable_answers) > 0 THEN t.acceptable_answers ELSE [coalesce(t.answer_text, '')] END", 'said')}), 0.0), 6) AS answer_exact_match, "
    + _decision_sql("t.decision = 'clarify'", f"({_decision('said')}) = 'clarify'", "coalesce(t.decision, '') <> ''")
    + " FROM s GROUP BY run_name"
)
def track_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(E.track_bundle(_scored(spark, folder), ["run_name"]), ("run_name",))


@query(f"WITH m AS (SELECT * FROM ({_FIRST}) WHERE split = 'dev' ORDER BY ord LIMIT 100) SELECT sample_id, source_dataset, task_type, split, len(images)::INTEGER AS images, {_TARGET} AS prediction, {_TARGET} AS reference_text, target.answer_text AS answer_text, target.canonical_label AS canonical_label, len(target.acceptable_answers)::INTEGER AS acceptable, target.decision AS decision, metadata FROM m")
def oracle_prediction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 examples, which is the feature, with their own targets as predictions."""
    rows = _first_rows(read(spark, folder, "manifest")).where("split = 'dev'")
    made = run_task("local_holdout", rows, "oracle", most=100)[1]
    return made.select("sample_id", "source_dataset", "task_type", "split", F.size("images").alias("images"), "prediction", "reference_text", "answer_text", "canonical_label", F.size("acceptable_answers").alias("acceptable"), "decision", "metadata")


# ---------------------------------------------------------------- normalisers


def _raw(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Raw rows of one source as its normaliser gets them; the record's id stands for its place in the file."""
    rows = read(spark, folder, "raw_records").where(F.lower(X.normalize_whitespace("source_dataset")) == source)
    return rows.select(F.col("record_id").alias("index"), "payload")


def _raw_sql(source: str) -> str:
    return f"r AS (SELECT record_id AS i, CASE WHEN json_valid(payload) THEN payload END AS p FROM raw_records WHERE lower({_ws('source_dataset')}) = '{source}')"


def _pick_sql(*names: str) -> str:
    """The first field that isn't missing, as JSON text."""
    return "coalesce(" + ", ".join(f"CASE WHEN json_extract(p, '$.{n}')::VARCHAR NOT IN {_in(N.FALSY)} THEN json_extract(p, '$.{n}')::VARCHAR END" for n in names) + ")"


def _text_sql(raw: str) -> str:
    return f"CASE WHEN starts_with({raw}, '\"') THEN json_extract_string({raw}, '$') ELSE {raw} END"


def _list_sql(raw: str) -> str:
    return f"CASE WHEN starts_with({raw}, '[') THEN json_extract({raw}, '$')::VARCHAR[] WHEN {raw} IS NOT NULL THEN [{_text_sql(raw)}] ELSE [] END"


def _split_sql(dataset: str) -> str:
    stated = _split_name(_text_sql(_pick_sql("split")))
    hashed = _fraction(f"'{dataset}-' || i", dataset)
    return f"coalesce(nullif({stated}, ''), CASE WHEN {hashed} < 0.8::DOUBLE THEN 'train' WHEN {hashed} < 0.9::DOUBLE THEN 'validation' ELSE 'test' END)"


_IMAGES = _list_sql(_pick_sql("images", "image_paths", "image", "img"))


def _id_sql(dataset: str) -> str:
    return f"'{dataset}-' || coalesce({_text_sql(_pick_sql('id'))}, i)"


_LISTED = f"list_filter({_list_sql(_pick_sql('all_labels', 'labels', 'categories'))}, lambda x: {_edges('x')} <> '')"


def _classification_sql(dataset: str, form) -> str:
    mode = "listed[list_position(list_transform(listed, lambda v: len(list_filter(listed, lambda x: x = v))), list_max(list_transform(listed, lambda v: len(list_filter(listed, lambda x: x = v)))))]"
    return (
        f"WITH {_raw_sql(dataset)}, c AS (SELECT *, {_LISTED} AS listed, nullif({_edges(_text_sql(_pick_sql('label', 'category')))}, '') AS own FROM r), d AS (SELECT *, coalesce(own, {mode}) AS label FROM c) "
        f"SELECT {_id_sql(dataset)} AS sample_id, {_split_sql(dataset)} AS split, len({_IMAGES})::INTEGER AS images, CASE WHEN len(listed) > 0 THEN {form('listed[1]')} WHEN label IS NOT NULL THEN {form('label')} END AS label, "
        f"CASE WHEN p IS NULL THEN 'payload is no JSON' WHEN len({_IMAGES}) = 0 THEN 'row is missing image fields' WHEN label IS NULL THEN 'classification record is missing a label' END AS error FROM d"
    )


def _classified(rows: DataFrame) -> DataFrame:
    label = F.when(F.col("target.canonical_label").isNotNull(), F.col("target.canonical_label"))
    return rows.select("sample_id", "split", F.size("images").alias("images"), F.when((F.col("error").isNull()) | (F.col("error") == "row is missing image fields"), label).alias("label"), "error")




@query(_classification_sql("plantvillage", _nl))
def normalize_classification(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(N.classification(_raw(spark, folder, "plantvillage"), "plantvillage", strict=False))


@query(_classification_sql("plantdoc", _nl))
def normalize_multi_label(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(N.classification(_raw(spark, folder, "plantdoc"), "plantdoc", strict=False))


@query(_classification_sql("ip102", lambda x: _ws(f"translate({x}, '_-', '  ')")))
def normalize_pests(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(N.classification(_raw(spark, folder, "ip102"), "ip102", pest=True, strict=False))


def _vqa_sql(dataset: str, task: str) -> str:
    raw, question = _pick_sql("answer", "response", "label"), _text_sql(_pick_sql("question", "query", "instruction"))
    decision = f"regexp_replace({_lower(_edges(_text_sql(_pick_sql('decision', 'expected_decision'))))}, '^[<>]+|[<>]+$', '', 'g')"
    return (
        f"WITH {_raw_sql(dataset)}, c AS (SELECT *, {raw} AS raw, {question} AS question, coalesce({_text_sql(_pick_sql('task_type'))}, '{task}') AS task_type, {decision} AS d FROM r), "
        f"e AS (SELECT *, CASE WHEN starts_with(raw, '[') THEN json_extract_string(raw, '$[0]') ELSE {_text_sql('raw')} END AS answer FROM c) "
        f"SELECT {_id_sql(dataset)} AS sample_id, task_type, {_split_sql(dataset)} AS split, len({_IMAGES})::INTEGER AS images, question, answer, "
        "CASE WHEN task_type = 'clarify_or_respond' AND d <> '' THEN CASE WHEN contains(d, 'respond') THEN 'respond' WHEN contains(d, 'clarify') OR contains(d, 'more info') OR contains(d, 'ask') THEN 'clarify' ELSE d END END AS decision, "
        f"CASE WHEN p IS NULL THEN 'payload is no JSON' WHEN len({_IMAGES}) = 0 THEN 'row is missing image fields' WHEN question IS NULL THEN 'row is missing a question' WHEN coalesce(answer, '') = '' THEN 'row is missing an answer' END AS error FROM e"
    )


def _answered(rows: DataFrame) -> DataFrame:
    question = F.element_at("messages", 2)["content"]
    return rows.select("sample_id", "task_type", "split", F.size("images").alias("images"), F.element_at(question, -1)["text"].alias("question"), F.col("target.answer_text").alias("answer"), F.col("target.decision").alias("decision"), "error")


@query(_vqa_sql("plantvillage_vqa", "vqa"))
def normalize_vqa(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(N.vqa(_raw(spark, folder, "plantvillage_vqa"), "plantvillage_vqa", strict=False))


@query(_vqa_sql("mirage", "clarify_or_respond"))
def normalize_clarify(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(N.vqa(_raw(spark, folder, "mirage"), "mirage", "clarify_or_respond", strict=False))


def _consultation_sql(dataset: str) -> str:
    diagnosis = f"nullif({_edges(_text_sql(_pick_sql('diagnosis', 'answer', 'label')))}, '')"
    steps = f"list_filter(list_transform({_list_sql(_pick_sql('management_steps', 'management'))}, lambda s: {_edges('s')}), lambda s: s <> '')"
    question = f"coalesce({_text_sql(_pick_sql('question', 'query'))}, '{X.DEFAULT_QUESTIONS['']}')"
    made = (
        f"'Diagnosis: ' || diagnosis || chr(10) || 'Evidence: {X.EVIDENCE_LINE}' || chr(10) || 'Uncertainty: ' || coalesce({_text_sql(_pick_sql('uncertainty'))}, '{X.UNCERTAINTY_LINE}') || chr(10) || 'Management: ' || "
        f"CASE WHEN len(steps) > 0 THEN array_to_string(steps, '; ') ELSE '{X.NO_STEPS_LINE}' END || chr(10) || 'Follow-up: {X.FOLLOW_UP_LINE}'"
    )
    return (
        f"WITH {_raw_sql(dataset)}, c AS (SELECT *, {diagnosis} AS diagnosis, {steps} AS steps FROM r) SELECT {_id_sql(dataset)} AS sample_id, coalesce({_text_sql(_pick_sql('task_type'))}, 'consultation') AS task_type, {_split_sql(dataset)} AS split, "
        f"len({_IMAGES})::INTEGER AS images, {question} AS question, CASE WHEN diagnosis IS NOT NULL THEN coalesce({_text_sql(_pick_sql('answer_text'))}, {made}) END AS answer, CASE WHEN diagnosis IS NOT NULL THEN {_nl('diagnosis')} END AS label, "
        f"CASE WHEN p IS NULL THEN 'payload is no JSON' WHEN len({_IMAGES}) = 0 THEN 'row is missing image fields' WHEN diagnosis IS NULL THEN 'consultation record is missing a diagnosis' END AS error FROM c"
    )


def _consulted(rows: DataFrame) -> DataFrame:
    question, good = F.element_at("messages", 2)["content"], F.coalesce(F.get_json_object("target.structured", "$.diagnosis"), F.lit("")) != ""
    return rows.select(
        "sample_id", "task_type", "split", F.size("images").alias("images"), F.element_at(question, -1)["text"].alias("question"), F.when(good, F.col("target.answer_text")).alias("answer"),
        F.when(good, F.col("target.canonical_label")).alias("label"), "error",
    )


@query(_consultation_sql("agbase"))
def normalize_consultation(spark: SparkSession, folder: str) -> DataFrame:
    return _consulted(N.consultation(_raw(spark, folder, "agbase"), "agbase", strict=False))


@query(_consultation_sql("agrillava"))
def normalize_conversation(spark: SparkSession, folder: str) -> DataFrame:
    return _consulted(N.consultation(_raw(spark, folder, "agrillava"), "agrillava", strict=False))


_DIR_SPLIT = f"list_filter(list_transform(string_split('data/raw/' || path, '/'), lambda p: {_split_name('p')}), lambda p: p IN ('train', 'validation', 'test', 'dev'))[1]"


@query(
    f"WITH i AS (SELECT DISTINCT image_path AS path FROM image_index) SELECT 'pictures-' || replace({_nl('path')}, ' ', '-') AS sample_id, {_nl("string_split(path, '/')[-2]")} AS label, 'data/raw/' || path AS image, "
    f"coalesce({_DIR_SPLIT}, CASE WHEN {_fraction('path', 'pictures-v1')} < 0.8::DOUBLE THEN 'train' WHEN {_fraction('path', 'pictures-v1')} < 0.9::DOUBLE THEN 'validation' ELSE 'test' END) AS split FROM i"
)
def normalize_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of the image index as a directory tree."""
    paths = read(spark, folder, "image_index").select(F.col("image_path").alias("path")).distinct().withColumn("index", F.lit(0))
    rows = N.classification_directory(paths, "pictures", "pictures-v1", "data/raw/")
    return rows.select("sample_id", F.col("target.canonical_label").alias("label"), F.get("images", F.lit(0)).alias("image"), "split")


@query(
    f"WITH i AS (SELECT DISTINCT image_path AS path, width % 40 AS id FROM image_index) SELECT path, id::VARCHAR AS label_id, {_ws("translate(coalesce(n_name, string_split(path, '/')[-2]), '_-', '  ')")} AS label FROM i LEFT JOIN nation ON id = n_nationkey"
)
def normalize_split_list(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a split list with class ids, named by the nations where there is one, else by the folder."""
    lines = read(spark, folder, "image_index").select(F.lit("train").alias("split"), F.col("image_path").alias("path"), (F.col("width") % 40).cast("string").alias("label_id")).distinct().withColumn("ord", F.lit(0))
    classes = read(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("label_id"), F.col("n_name").alias("label"))
    rows = N.split_lists(lines, classes, "pictures")
    meta = F.col("metadata")
    return rows.select(F.get("images", F.lit(0)).alias("path"), F.get_json_object(meta, "$.label_id").alias("label_id"), F.col("target.canonical_label").alias("label"))


@query("SELECT DISTINCT m.image, m.sample_id FROM (SELECT sample_id, unnest(images) AS image FROM manifest) m WHERE m.image NOT IN (SELECT image_path FROM image_index)")
def missing_files(spark: SparkSession, folder: str) -> DataFrame:
    listing = read(spark, folder, "image_index").select(F.col("image_path").alias("path"))
    return N.missing_files(read(spark, folder, "manifest"), listing).select("image", "sample_id").distinct()


