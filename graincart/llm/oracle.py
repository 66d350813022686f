"""The results of training-data queries stated in SQL, for DuckDB.

What a corpus says of broken-off texts, a tokenizer, an allocation with its draws and a packing have none: they are tested
against brute force, reference tokenizers and bounds, and the pN_checks state in SQL what must hold of their results.
"""

from __future__ import annotations

from graincart.queries import WS, _in, _nl, _split_name, _ws

RECORDS = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS k FROM manifest WHERE sample_id IS NOT NULL) WHERE k = 1"


def _name(x: str) -> str:
    return f"lower({_ws(x)})"


def _letters(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"


_CELLS = f"r AS (SELECT sample_id, {_name('source_dataset')} AS source_dataset, {_name('task_type')} AS task_type, {_split_name('split')} AS split FROM ({RECORDS}))"

_P1 = f"""WITH r AS (SELECT sample_id, {_split_name('split')} AS split, images FROM ({RECORDS})),
s AS (SELECT DISTINCT sample_id, split = 'train' AS train, {_letters('image')} AS path FROM (SELECT sample_id, split, unnest(images) AS image FROM r WHERE split <> '')),
i AS (SELECT DISTINCT {_letters('image_path')} AS path, content_sha, fingerprint FROM image_index),
p AS (SELECT sample_id, train, s.path, content_sha, fingerprint FROM s LEFT JOIN i ON s.path = i.path WHERE s.path <> ''),
f AS (SELECT a.fingerprint AS fa, b.fingerprint AS fb FROM (SELECT DISTINCT fingerprint FROM p WHERE train AND fingerprint IS NOT NULL) a, (SELECT DISTINCT fingerprint FROM p WHERE NOT train AND fingerprint IS NOT NULL) b WHERE bit_count(xor(a.fingerprint, b.fingerprint)) <= 4),
m AS (SELECT a.sample_id AS a, b.sample_id AS b FROM p a JOIN p b ON a.path = b.path AND a.train AND NOT b.train
UNION SELECT a.sample_id, b.sample_id FROM p a JOIN p b ON a.content_sha = b.content_sha AND a.train AND NOT b.train AND a.content_sha <> ''
UNION SELECT a.sample_id, b.sample_id FROM f JOIN p a ON a.fingerprint = fa AND a.train JOIN p b ON b.fingerprint = fb AND NOT b.train)
"""

P3 = f"""WITH {_CELLS}, n AS (SELECT source_dataset, count(*) AS n FROM r GROUP BY ALL)
SELECT m.source_dataset FROM (SELECT {_name('source_dataset')} AS source_dataset, max(target_permille) AS t, max(max_repeats) AS k FROM mix_targets GROUP BY 1) m LEFT JOIN n ON m.source_dataset = n.source_dataset
WHERE coalesce(n, 0) * k * 1000 < t * (SELECT count(*) FROM r)"""



#: Fixed values, stated here on their own: ids that say nothing.
PLACEHOLDERS = ("", "na", "nan", "none", "null", "nil", "unknown", "anonymous", "anon", "undefined", "unspecified", "notavailable", "missing", "tbd", "0")


def _key(kind: str, field: str, scope: str = "") -> str:
    ident = _letters(f"json_extract_string(metadata, '$.{field}')")
    middle = f"{scope} || chr(31) || " if scope else ""
    return f"SELECT sample_id, '{kind}' || chr(31) || {middle}{ident} AS key FROM r WHERE {ident} NOT IN {_in(PLACEHOLDERS)}"


P4 = f"""WITH RECURSIVE r AS (SELECT sample_id, {_split_name('split')} AS split, {_name('source_dataset')} AS source_dataset, metadata FROM ({RECORDS})),
k AS ({_key('author', 'contributor_id')} UNION {_key('author', 'submitted_by')} UNION {_key('plant', 'plant_id')} UNION {_key('picture', 'source_image_id', 'source_dataset')}),
c AS (SELECT key, min(sample_id) AS hub FROM k GROUP BY key HAVING count(*) > 1),
e AS (SELECT sample_id AS a, hub AS b FROM k JOIN c USING (key) UNION SELECT hub, sample_id FROM k JOIN c USING (key)),
w(root, node) AS (SELECT a, a FROM e UNION SELECT w.root, e.b FROM w JOIN e ON w.node = e.a),
g AS (SELECT node AS sample_id, min(root) AS group_id FROM w GROUP BY node),
d AS (SELECT group_id FROM g JOIN r USING (sample_id) WHERE split <> '' GROUP BY group_id HAVING count(DISTINCT split) > 1)
SELECT group_id, sample_id FROM g WHERE group_id IN (SELECT group_id FROM d)"""

_TERMS = f"""WITH r AS (SELECT {_nl('target.canonical_label')} AS label, {_nl('task_type')} AS task FROM ({RECORDS})),
t AS (SELECT 'canonical_label' AS field_name, label AS value, 1 AS n FROM r UNION ALL SELECT 'task_type', task, 1 FROM r
UNION ALL SELECT 'label_term', w, len(list_filter(string_split(label, ' '), lambda x: x = w)) FROM (SELECT label, unnest(list_distinct(string_split(label, ' '))) AS w FROM r)),
c AS (SELECT field_name, value, sum(n)::BIGINT AS occurrences, count(*) AS records FROM t WHERE value <> '' GROUP BY ALL)
SELECT field_name, value, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 20 > (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c"""


def _fold(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '[\p{{P}}{WS[1:-1]}]+', '', 'g'))"


_CANON = (
    f"array_to_string(list_sort(list_distinct(list_transform(list_concat(coalesce(images, []), list_transform(list_filter(flatten(list_transform(messages, lambda m: m.content)), lambda p: p.image IS NOT NULL), lambda p: p.image)), lambda p: {_letters('p')}))), chr(30)) || chr(31) || "
    f"{_fold('target.answer_text')} || chr(31) || array_to_string(list_transform(messages, lambda m: {_fold('m.role')} || chr(29) || array_to_string(list_sort(list_transform(list_filter(m.content, lambda p: p.text IS NOT NULL), lambda p: {_fold('p.text')})), chr(30))), chr(31))"
)
_GROUPS = f"g AS (SELECT sample_id, min(sample_id) OVER (PARTITION BY c) AS group_id, count(*) OVER (PARTITION BY c) AS copies FROM (SELECT sample_id, {_CANON} AS c FROM ({RECORDS})))"

_WANTED = f"w AS (SELECT {_name('source_dataset')} AS source_dataset, {_name('task_type')} AS task_type, {_split_name('split')} AS split, max(target_permille) AS t, max(min_records) AS least FROM sample_targets GROUP BY 1, 2, 3)"
P7 = f"""WITH {_CELLS}, {_WANTED}, n AS (SELECT source_dataset, task_type, split, count(*) AS n FROM r GROUP BY ALL)
SELECT source_dataset, task_type, split FROM w LEFT JOIN n USING (source_dataset, task_type, split)
WHERE coalesce(n, 0) < least OR coalesce(n, 0) * 1000 < t * ((SELECT count(*) FROM r) // 10)"""

#: Fixed values, stated here on their own: letters of other alphabets that occur in the tables, and characters without a width.
_PAIRS = [
    pair
    for table in (
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυϲϳ", "ABEZHIKMNOPTYXavopucj"),
        ("АВЕЅІЈКМНОРСТУҮХԌԚԜаеорсуүхѕіјһԁԛԝӏ", "ABESIJKMHOPCTYYXGQWaeopcyyxsijhdqwl"),
        ("ՍՏՕհոսօզ", "USOhnuoq"),
        ("ᎪᎫᎬᎳᎷᎻᎢᏀᏃᏚᏟᏢᏦᏴ", "AJEWMHTGZSCPKB"),
        ("ⲞⲟⲢⲣⲤⲥⲔⲘⲚⲎⲦⲬ", "OoPpCcKMNHTX"),
    )
    for pair in zip(*table)
]
_WIDTHLESS = [0x00AD, 0x034F, 0x061C, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
_WIDE = [(chr(0xFF01 + i), chr(0x21 + i)) for i in range(94)]
_SPACES = [(chr(c), " ") for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
_FROM = "".join(a for a, _ in _PAIRS + _WIDE + _SPACES)
_TO = "".join(b for _, b in _PAIRS + _WIDE + _SPACES).replace("'", "''")
_DROP = "".join(rf"\x{{{c:x}}}" for c in _WIDTHLESS)
#: Composed forms in place of decomposed ones: DuckDB only has NFC, and the two tell the same texts apart.
_SKELETON = f"nfc_normalize(translate(regexp_replace(nfc_normalize(text), '[{_DROP}]+', '', 'g'), '{_FROM}', '{_TO}'))"
P10 = rf"""WITH d AS (SELECT doc_id, text, {_SKELETON} AS s FROM documents WHERE text IS NOT NULL), v AS (SELECT * FROM d WHERE regexp_matches(s, '[^\p{{Cc}}\p{{Cf}}{WS[1:-1]}]'))
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.s = b.s AND a.text <> b.text AND a.doc_id < b.doc_id"""

ORACLE = {
    "p1_found": f"{_P1} SELECT DISTINCT least(a, b) AS sample_id_a, greatest(a, b) AS sample_id_b FROM m",
    "p1_counts": f"{_P1}, o AS (SELECT sample_id AS b, {_split_name('split')} AS split, {_name('source_dataset')} AS source_dataset FROM ({RECORDS})) SELECT split, source_dataset, count(*) AS pairs, count(DISTINCT b) AS records FROM m JOIN o USING (b) GROUP BY ALL",
    "p1_pictures": f"""{_P1}, k AS (SELECT sample_id, train, unnest([{{'kind': 'p', 'name': path}}, {{'kind': 's', 'name': nullif(content_sha, '')}}, {{'kind': 'f', 'name': fingerprint::VARCHAR}}]) AS v FROM p),
c AS (SELECT train, v.kind AS kind, v.name AS name, count(DISTINCT sample_id) AS n FROM k WHERE v.name IS NOT NULL GROUP BY ALL)
SELECT a.kind, a.name AS name_a, b.name AS name_b, a.n AS train_records, b.n AS other_records FROM c a JOIN c b ON a.train AND NOT b.train AND a.kind = b.kind
WHERE CASE WHEN a.kind = 'f' THEN (TRY_CAST(a.name AS BIGINT), TRY_CAST(b.name AS BIGINT)) IN (SELECT (fa, fb) FROM f) ELSE a.name = b.name END""",
    "p3_found": P3,
    "p3_checks": f"""WITH {_CELLS}, n AS (SELECT source_dataset, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT {_name('source_dataset')} AS source_dataset, max(target_permille) AS t, max(max_repeats) AS k FROM mix_targets GROUP BY 1)
SELECT source_dataset, coalesce(n, 0) AS records, coalesce(n, 0) * k AS capacity, coalesce(n, 0) * k * 1000 < t * (SELECT count(*) FROM r) AS falls_short, true AS within, true AS met, true AS whole FROM m LEFT JOIN n USING (source_dataset)""",
    "p4_found": P4,
    "p4_checks": P4[: P4.rindex("SELECT group_id, sample_id")] + "SELECT (SELECT count(*) FROM r) AS records, (SELECT count(DISTINCT group_id) FROM g) AS groups, 0 AS parted, true AS within",
    "p5_found": f"SELECT field_name, value, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p5_counts": _TERMS,
    "p6_found": f"WITH {_GROUPS} SELECT group_id AS sample_id_a, sample_id AS sample_id_b FROM g WHERE sample_id <> group_id",
    "p6_records": f"WITH {_GROUPS} SELECT sample_id, copies FROM g WHERE sample_id = group_id",
    "p7_found": P7,
    "p7_checks": f"""WITH {_CELLS}, {_WANTED}, n AS (SELECT source_dataset, task_type, split, count(*) AS n FROM r GROUP BY ALL)
SELECT source_dataset, task_type, split, coalesce(n, 0) AS records, coalesce(n, 0) < least OR coalesce(n, 0) * 1000 < t * ((SELECT count(*) FROM r) // 10) AS unmet, true AS within, true AS least, true AS once, true AS given FROM w LEFT JOIN n USING (source_dataset, task_type, split)""",
    "p9_checks": "SELECT count(DISTINCT doc_id) AS documents, true AS fits, true AS tight FROM documents",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_found": P10,
    "p10_classes": P10[: P10.index("SELECT a.doc_id")] + "SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) - count(*) OVER (PARTITION BY s, text) AS links FROM v QUALIFY links > 0",
}
