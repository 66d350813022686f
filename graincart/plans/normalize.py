"""Raw records to unified rows.

Raw rows have a JSON object in `payload` and their position in `index`. Fields are found by chains of names, where a
null, empty or zero value passes on to the next name. Each normaliser gives unified rows with `error`, null for a
good row; `strict` makes the first error fail the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.hashing import hash_split
from graincart.functions.text import (
    DEFAULT_QUESTIONS,
    SECTIONS,
    SYSTEM_PROMPT,
    UNCERTAINTY_LINE,
    detect_split_from_path,
    normalize_decision,
    normalize_edges,
    normalize_label,
    normalize_split_name,
    parse_pest_label,
    parse_plant_label,
    slugify,
    structured_answer,
    user_question,
)
from graincart.operators.sampling import mode_of_array
from graincart.operators.schema import FIELDS, MESSAGES, REWARD_META, TARGET, VERIFIER
from graincart.session import hinted

#: JSON texts of values that count as missing.
FALSY = ("null", '""', "[]", "{}", "0", "0.0", "false")
#: The weights of consultation rows, and the question of the split-list normaliser.
CONSULTATION_WEIGHTS = {"normalized_label": 1.0, "structured_format": 0.5, "uncertainty_calibration": 0.5, "management_coverage": 0.5, "hallucination_penalty": 1.0}
CLASSIFICATION_WEIGHTS = {"normalized_label": 1.0, "hallucination_penalty": 1.0}
PEST_QUESTION = "Identify the insect or pest shown in this agricultural image."
#: What staged question-answer records ask, and say where no part of the answer is stated; the question of pictures in folders.
STAGED_QUESTION = "Provide an expert agricultural diagnosis and management plan for the issue shown."
STAGED_DIAGNOSIS = "See source-authored answer."
FOLDER_QUESTION = DEFAULT_QUESTIONS["classification"]


def parsed(rows: DataFrame) -> DataFrame:
    """`rows` with the payload parsed once; broken JSON gives null."""
    return rows.withColumn("_v", F.try_parse_json("payload"))


def pick(*names: str) -> Column:
    """JSON text of the first field that isn't missing, or null."""
    found = []
    for name in names:
        raw = F.to_json(F.try_variant_get("_v", f"$.{name}", "variant"))
        found.append(F.when(~raw.isin(*FALSY), raw))
    return F.coalesce(*found)


def text_of(raw: Column) -> Column:
    """A JSON value as text: strings unquoted, all else as JSON writes it."""
    return F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit("["), raw, F.lit("]")), "$[0]")).otherwise(raw)


def list_of(raw: Column) -> Column:
    """A JSON value as strings: a list's elements, or the value alone; an empty array for null."""
    many = F.from_json(raw, "array<string>")
    return F.coalesce(F.when(raw.startswith("["), many).when(raw.isNotNull(), F.array(text_of(raw))), F.array().cast("array<string>"))


def messages(question: Column, images: Column) -> Column:
    """The system's text, then one user turn: all pictures and the question."""

    def part(kind: str, value: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("type"), (value if kind == "text" else none).alias("text"), (value if kind == "image" else none).alias("image"))

    system = F.struct(F.lit("system").alias("role"), F.array(part("text", F.lit(SYSTEM_PROMPT))).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.concat(F.transform(images, lambda p: part("image", p)), F.array(part("text", question))).alias("content"))
    return F.array(system, user).cast(MESSAGES)


def _struct(kind: str, **values: Column) -> Column:
    """A struct of the given DDL type; fields left out are empty arrays and maps, false, or null."""
    inner = kind[len("struct<") : -1]
    names, depth, start = [], 0, 0
    for i, ch in enumerate(inner + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(inner[start:i].split(":", 1))
            start = i + 1
    parts = []
    for name, of in names:
        if name in values:
            value = values[name]
        elif of.startswith("array"):
            value = F.array()
        elif of.startswith("map"):
            value = F.create_map()
        elif of == "boolean":
            value = F.lit(False)
        else:
            value = F.lit(None)
        parts.append(value.cast(of).alias(name))
    return F.struct(*parts)


def _weights(weights: Mapping[str, float]) -> Column:
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]) if weights else F.create_map().cast("map<string,double>")


def _metadata(provenance: Mapping[str, Any], license_name: str | None, **values: Column) -> Column:
    """JSON object: what the download says of itself, overridden by the row's own fields, and the license if there is one."""
    fixed = {k: F.lit(json.dumps(v) if isinstance(v, (dict, list)) else v) for k, v in provenance.items() if k not in values}
    if license_name:
        values = {**values, "license": F.lit(license_name)}
    return F.to_json(F.struct(*[c.alias(k) for k, c in {**fixed, **values}.items()]), {"ignoreNullFields": "false"})


def unified(rows: DataFrame, error: Column, strict: bool, **columns: Column) -> DataFrame:
    """Unified rows with `ord` and `error`. Under `strict` an error fails the job where the row is read."""
    made = rows.select(*[columns[name].cast(kind).alias(name) for name, kind in FIELDS.items()], F.col("index").alias("ord"), error.alias("error"))
    if strict:
        made = made.withColumn("sample_id", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("sample_id"))).drop("error")
    return made


def _kept(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with more columns, which later expressions refer to instead of working them out again."""
    return rows.withColumns(columns)


def _split(dataset: str) -> Column:
    """The stated split, else a hashed one."""
    stated = F.nullif(normalize_split_name(text_of(pick("split"))), F.lit(""))
    return F.coalesce(stated, hash_split(F.concat(F.lit(f"{dataset}-"), F.col("index").cast("string")), dataset))


def _sample_id(dataset: str) -> Column:
    return F.concat(F.lit(f"{dataset}-"), F.coalesce(text_of(pick("id")), F.col("index").cast("string")))


def located(images: Column, prefix: str) -> Column:
    """Paths from the data set as paths from the repository; absolute ones stay."""
    return F.transform(images, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(prefix), p))) if prefix else images


def _picture_id() -> Column:
    return F.coalesce(text_of(pick("image")), text_of(pick("id")), F.col("index").cast("string"))


def _error(*checks: tuple[str, Column]) -> Column:
    """The first failing check's message; broken JSON is the first of all."""
    result = F.when(F.col("_v").isNull(), "payload is no JSON")
    for message, fails in checks:
        result = result.when(fails, message)
    return result


def classification(rows: DataFrame, dataset: str, pest: bool = False, prefix: str = "", license_name: str | None = None, provenance: Mapping[str, Any] = {}, strict: bool = True) -> DataFrame:
    """Records with a label or several. The label is `label` or `category`, else the most common of the list; the canonical label is the list's first."""
    form: Callable[[Column], Column] = parse_pest_label if pest else normalize_label
    listed = F.filter(list_of(F.col("_list")), lambda x: normalize_edges(x) != "")
    own = F.nullif(normalize_edges(text_of(F.col("_own"))), F.lit(""))
    rows = _kept(parsed(rows), _list=pick("all_labels", "labels", "categories"), _own=pick("label", "category"), _shown=pick("images", "image_paths", "image", "img"))
    rows = _kept(rows, _listed=listed, _images=located(list_of(F.col("_shown")), prefix))
    rows = _kept(rows, _label=F.coalesce(own, mode_of_array(F.col("_listed"))))
    rows = _kept(rows, _candidates=F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(F.array("_label")), _plant=parse_plant_label("_label"))
    rows = _kept(rows, _labels=F.transform("_candidates", lambda x: form(x)))
    label, candidates, labels, plant, images = (F.col(c) for c in ("_label", "_candidates", "_labels", "_plant", "_images"))
    canonical = F.get(labels, F.lit(0))
    none = F.lit(None).cast("string")
    meta = _metadata(
        provenance, license_name, crop=F.coalesce(text_of(pick("crop")), plant["crop"]), disease=F.coalesce(text_of(pick("disease")), none if pest else plant["disease"]),
        pest=F.coalesce(text_of(pick("pest")), canonical if pest else none), original_label=label, original_labels=candidates, normalized_label=canonical, normalized_labels=labels,
        source_image_id=_picture_id(), template_origin=F.coalesce(text_of(pick("template_origin")), F.lit("source_authored")),
    )
    return unified(
        rows, _error(("row is missing image fields", F.size(images) == 0), ("classification record is missing a label", label.isNull())), strict,
        sample_id=_sample_id(dataset), source_dataset=F.lit(dataset), task_type=F.lit("classification"), split=_split(dataset), images=images,
        messages=messages(user_question(F.lit("classification"), text_of(pick("question"))), images), target=_struct(TARGET, answer_text=canonical, canonical_label=canonical), metadata=meta,
        verifier=_struct(VERIFIER, mode=F.lit("label"), accepted_labels=labels), reward_meta=_struct(REWARD_META, weights=_weights(CLASSIFICATION_WEIGHTS)),
    )


def vqa(rows: DataFrame, dataset: str, default_task: str = "vqa", prefix: str = "", license_name: str | None = None, provenance: Mapping[str, Any] = {}, strict: bool = True) -> DataFrame:
    """Questions with answers. A list of answers counts with its first; a clarify task is verified by its decision, any other by exact match."""
    raw = F.col("_answer")
    rows = _kept(
        parsed(rows), _answer=pick("answer", "response", "label"), _asked=pick("question", "query", "instruction"), _kind=pick("task_type"), _said=pick("decision", "expected_decision"),
        _shown=pick("images", "image_paths", "image", "img"),
    )
    rows = _kept(rows, _answer=F.when(raw.startswith("["), F.get(list_of(raw), F.lit(0))).otherwise(text_of(raw)), _asked=text_of(F.col("_asked")), _kind=F.coalesce(text_of(F.col("_kind")), F.lit(default_task)), _images=located(list_of(F.col("_shown")), prefix))
    rows = _kept(rows, _decision=F.when(F.col("_kind") == "clarify_or_respond", normalize_decision(text_of(F.col("_said")))))
    answer, question, task, decision, images = (F.col(c) for c in ("_answer", "_asked", "_kind", "_decision", "_images"))
    clarify = task == "clarify_or_respond"
    meta = _metadata(
        provenance, license_name, crop=text_of(pick("crop")), disease=text_of(pick("disease")), pest=text_of(pick("pest")), source_image_id=_picture_id(),
        template_origin=F.coalesce(text_of(pick("template_origin")), F.lit("human_or_source_authored")), benchmark_track=text_of(pick("benchmark_track")), options=pick("options"),
    )
    return unified(
        rows, _error(("row is missing image fields", F.size(images) == 0), ("row is missing a question", question.isNull()), ("row is missing an answer", F.coalesce(answer, F.lit("")) == "")), strict,
        sample_id=_sample_id(dataset), source_dataset=F.lit(dataset), task_type=task, split=_split(dataset), images=images, messages=messages(question, images),
        target=_struct(TARGET, answer_text=answer, decision=decision, acceptable_answers=F.array(answer)), metadata=meta,
        verifier=_struct(VERIFIER, mode=F.when(clarify, "clarify").otherwise("exact_match"), accepted_answers=F.array(answer), expected_decision=decision, management_keywords=list_of(pick("management_keywords"))),
        reward_meta=_struct(REWARD_META, weights=F.coalesce(F.from_json(pick("reward_weights"), "map<string,double>"), _weights({}))),
    )


def consultation(rows: DataFrame, dataset: str, prefix: str = "", license_name: str | None = None, provenance: Mapping[str, Any] = {}, strict: bool = True) -> DataFrame:
    """Diagnoses with steps; without an answer text one of five sections is written."""
    rows = _kept(
        parsed(rows), _diagnosis=pick("diagnosis", "answer", "label"), _steps=pick("management_steps", "management"), _unsure=pick("uncertainty"), _shown=pick("images", "image_paths", "image", "img")
    )
    rows = _kept(rows, _diagnosis=F.nullif(normalize_edges(text_of(F.col("_diagnosis"))), F.lit("")), _steps=list_of(F.col("_steps")), _images=located(list_of(F.col("_shown")), prefix))
    diagnosis, steps, images = (F.col(c) for c in ("_diagnosis", "_steps", "_images"))
    uncertainty = F.coalesce(text_of(F.col("_unsure")), F.lit(UNCERTAINTY_LINE))
    answer = F.coalesce(text_of(pick("answer_text")), structured_answer(diagnosis, steps, uncertainty))
    question = F.coalesce(text_of(pick("question", "query")), user_question(F.lit("consultation"), F.lit(None).cast("string")))
    label = normalize_label(diagnosis)
    sections = list_of(pick("required_sections"))
    required = F.to_json(F.try_variant_get("_v", "$.uncertainty_required", "variant"))
    meta = _metadata(
        provenance, license_name, crop=text_of(pick("crop")), disease=F.coalesce(text_of(pick("disease")), diagnosis), pest=text_of(pick("pest")), source_image_id=_picture_id(),
        template_origin=F.coalesce(text_of(pick("template_origin")), F.lit("human_or_source_authored")), benchmark_track=text_of(pick("benchmark_track")),
    )
    return unified(
        rows, _error(("row is missing image fields", F.size(images) == 0), ("consultation record is missing a diagnosis", diagnosis.isNull())), strict,
        sample_id=_sample_id(dataset), source_dataset=F.lit(dataset), task_type=F.coalesce(text_of(pick("task_type")), F.lit("consultation")), split=_split(dataset), images=images,
        messages=messages(question, images), target=_struct(TARGET, answer_text=answer, canonical_label=label, structured=F.to_json(F.struct(diagnosis.alias("diagnosis"), steps.alias("management_steps")))), metadata=meta,
        verifier=_struct(
            VERIFIER, mode=F.lit("structured"), accepted_labels=F.array(label), required_sections=F.when(F.size(sections) > 0, sections).otherwise(F.array(*[F.lit(s) for s in SECTIONS])),
            management_keywords=steps, uncertainty_required=F.coalesce(~required.isin(*FALSY), F.lit(True)),
        ),
        reward_meta=_struct(REWARD_META, weights=F.coalesce(F.from_json(pick("reward_weights"), "map<string,double>"), _weights(CONSULTATION_WEIGHTS)), structured_output_required=F.lit(True)),
    )


def _labelled_images(rows: DataFrame, dataset: str, split: Column, image: Column, labels: list[Column], meta: Column, question: str) -> DataFrame:
    images = F.array(image)
    return unified(
        rows, F.lit(None).cast("string"), True, sample_id=F.concat(F.lit(f"{dataset}-"), slugify("path")), source_dataset=F.lit(dataset), task_type=F.lit("classification"), split=split, images=images,
        messages=messages(F.lit(question), images), target=_struct(TARGET, answer_text=labels[0], canonical_label=labels[0]), metadata=meta,
        verifier=_struct(VERIFIER, mode=F.lit("label"), accepted_labels=F.array(*labels)), reward_meta=_struct(REWARD_META, weights=_weights(CLASSIFICATION_WEIGHTS)),
    )


def classification_directory(paths: DataFrame, dataset: str, salt: str, prefix: str = "", pest: bool = False, license_name: str | None = None, provenance: Mapping[str, Any] = {}) -> DataFrame:
    """Images (`path` relative to the data set, `index`) labelled by their folder. `prefix` leads from the repository to the data set.

    The split is the first folder of the whole path that is named like one, else hashed.
    """
    name = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    full = F.concat(F.lit(prefix), F.col("path"))
    plant, none = parse_plant_label(name), F.lit(None).cast("string")
    label = parse_pest_label(name) if pest else normalize_label(name)
    meta = _metadata(
        provenance, license_name, crop=plant["crop"], disease=none if pest else plant["disease"], pest=label if pest else none, original_label=name, normalized_label=label,
        template_origin=F.lit("templated_from_label"), source_image_id=F.col("path"),
    )
    split = F.coalesce(detect_split_from_path(full), hash_split(F.col("path"), salt))
    return _labelled_images(paths, dataset, split, full, [label, normalize_label(name)], meta, FOLDER_QUESTION)


def with_labels(rows: DataFrame, classes: DataFrame, key: str = "label_id") -> DataFrame:
    """`rows` with `label` from a class list (`key`, label); null where the list has none. A class list has one row a class and is broadcast if it is small."""
    return rows.join(hinted(classes), key, "left")


def split_lists(lines: DataFrame, classes: DataFrame | None, dataset: str, prefix: str = "", license_name: str | None = None, provenance: Mapping[str, Any] = {}) -> DataFrame:
    """Lines of split lists (split, path, label_id, ord), labelled by the class list, else by their folder."""
    folder = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    rows = lines.withColumn("index", F.col("ord"))
    if classes is None:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    else:
        rows = with_labels(rows, classes)
    label = F.when(F.col("label").isNotNull(), parse_pest_label("label")).otherwise(parse_pest_label(folder))
    meta = _metadata(
        provenance, license_name, pest=label, label_id=F.col("label_id"), original_label=F.coalesce(F.nullif(folder, F.lit("")), F.col("label_id")), normalized_label=label, source_image_id=F.col("path")
    )
    return _labelled_images(rows, dataset, F.col("split"), F.concat(F.lit(prefix), F.col("path")), [label], meta, PEST_QUESTION)


def missing_files(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Images of `rows` that the listing (`path`) lacks: image, sample_id."""
    return rows.select("sample_id", F.explode("images").alias("image")).join(listing.select(F.col("path").alias("image")), "image", "left_anti")


def question_answer_records(rows: DataFrame, existing: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Question-answer JSON (`payload`, `index`) to consultation records: (records with `payload`, one row with `skipped` rows without an image).

    Images that `existing` (path) lacks are dropped; the diagnosis is the issue, else the species, symptom or management.
    """
    source = parsed(rows)
    images = source.select("index", F.explode(list_of(pick("images"))).alias("path")).join(existing.select("path"), "path", "left_semi")
    kept = images.groupBy("index").agg(F.sort_array(F.collect_set("path")).alias("images"))
    joined = source.join(kept, "index", "left")

    def answer(topic: str) -> Column:
        return normalize_edges(F.coalesce(F.get_json_object("payload", f"$['finetuning qa']['{topic}'].a"), F.lit("")))

    species, issue, symptom, management = (answer(t) for t in ("species", "disease/issue identification", "symptom description", "management instructions"))
    diagnosis = F.coalesce(*[F.nullif(x, F.lit("")) for x in (issue, species, symptom, management)], F.lit(STAGED_DIAGNOSIS))
    lines = F.concat_ws("\n", *[F.when(x != "", F.concat(F.lit(f"{head}: "), x)) for head, x in (("Species", species), ("Diagnosis", issue), ("Symptoms", symptom), ("Management", management))])
    record = F.to_json(F.struct(
        F.concat(F.lit(f"{dataset}-"), F.coalesce(text_of(pick("faq-id")), F.col("index").cast("string"))).alias("id"), F.col("images"), F.get("images", F.lit(0)).alias("image"),
        F.lit(STAGED_QUESTION).alias("question"), diagnosis.alias("diagnosis"),
        F.when(management != "", F.array(management)).otherwise(F.array().cast("array<string>")).alias("management_steps"), F.when(lines != "", lines).otherwise(diagnosis).alias("answer_text"),
        F.lit("train").alias("split"), F.nullif(species, F.lit("")).alias("crop"), F.lit("source_authored").alias("template_origin"),
    ))
    has = F.size(F.coalesce(F.col("images"), F.array().cast("array<string>"))) > 0
    return joined.where(has).select("index", record.alias("payload")), joined.agg(F.count_if(~has).alias("skipped"))


def conversation_records(rows: DataFrame, dataset: str, folder: str = "") -> DataFrame:
    """Conversations (`payload`, `index`) to consultation records: the first two turns are question and answer; too few or empty ones are an error."""
    source = parsed(rows)
    turn = [normalize_edges(F.coalesce(F.get_json_object("payload", f"$.conversations[{i}].value"), F.lit(""))) for i in (0, 1)]
    image = F.coalesce(F.try_element_at(F.split(text_of(pick("image")), "/"), F.lit(-1)), F.lit(""))
    bad = F.when(image == "", "talk without a picture").when((turn[0] == "") | (turn[1] == ""), "talk with a missing question or answer")
    record = F.to_json(F.struct(
        F.concat(F.lit(f"{dataset}-"), F.lpad(F.col("index").cast("string"), 6, "0")).alias("id"), F.concat(F.lit(folder), image).alias("image"), turn[0].alias("question"), turn[1].alias("diagnosis"),
        turn[1].alias("answer_text"), F.array().cast("array<string>").alias("management_steps"), F.lit("train").alias("split"), F.lit("source_authored").alias("template_origin"),
    ))
    return source.select("index", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(record).alias("payload"))


#: Normalisers by the name that the registry gives them. A new one is added here.
NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "classification_records": classification,
    "ip102": lambda rows, dataset, **options: classification(rows, dataset, pest=True, **options),
    "vqa_records": vqa,
    "consultation_records": consultation,
}


def normalize(rows: DataFrame, dataset: str, normalizer: str, default_task: str | None = None, **options: Any) -> DataFrame:
    """One data set's raw rows by the registry's normaliser; an unknown name is a KeyError."""
    if normalizer == "vqa_records" and default_task:
        options["default_task"] = default_task
    return NORMALIZERS[normalizer](rows, dataset, **options)
