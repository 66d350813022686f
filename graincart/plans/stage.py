"""From what a source delivers to record files: row mappings of the materialisers, an archive with a table, and the acquisition loop.

Rows have a JSON object in `payload` and their place in `index`, as in normalize. Fetching from a network is left to
the caller, who gives the rows.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tarfile
import zipfile
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.text import canonical_split, normalize_decision, normalize_edges, parse_plant_label
from graincart.operators.sampling import mode_of_array, prefix_quota
from graincart.plans.normalize import list_of, parsed, pick, text_of
from graincart.sources.files import manual_slot, write_sidecar
from graincart.sources.paths import DatasetSpec, download_mode

#: The fields that questions, answers and goals are found in, in order.
QUESTIONS = ("question", "query", "prompt", "instruction", "dialog_context", "user", "text")
ANSWERS = ("answer", "response", "utterance", "assistant_response", "expert_response", "label", "output")
TRACK_QUESTIONS = ("dialog_context", "question", "query", "prompt", "user")
TRACK_ANSWERS = ("utterance", "answer", "response", "assistant_response", "expert_response")
#: Where a track finds its goals.
GOALS = ("known_goal", "goals", "management_keywords")


def first_non_empty(*names: str) -> Column:
    """JSON text of the first field that is neither null, blank nor an empty list or object; unlike `pick`, 0 and false are values."""
    found = []
    for name in names:
        raw = F.to_json(F.try_variant_get("_v", f"$.{name}", "variant"))
        blank = raw.isin("null", "[]", "{}") | (raw.startswith('"') & (normalize_edges(text_of(raw)) == ""))
        found.append(F.when(~blank, raw))
    return F.coalesce(*found)


def image_columns(names: Iterable[str]) -> list[str]:
    """The names that hold pictures (image, png, jpg, jpeg, image_<n>), in their order."""
    return [n for n in names if re.fullmatch(r"image|png|jpe?g|image_\d+", n.lower())]


def decode_label(value: Column, names: list[str], deep: int = 2) -> Column:
    """A class id as its name; anything else stays. Null without a name of that number. The elements of a JSON list are decoded each, `deep` lists down."""
    if not names:
        return value
    number = value.try_cast("int")
    one = F.when(number.isNull(), value).otherwise(F.get(F.array(*[F.lit(n) for n in names]), number))
    if not deep:
        return one
    many = F.to_json(F.transform(F.from_json(value, "array<string>"), lambda x: decode_label(x, names, deep - 1)), {"ignoreNullFields": "false"})
    return F.when(value.startswith("["), many).otherwise(one)


def _record(rows: DataFrame, error: Column, **fields: Column) -> DataFrame:
    """index, payload; a row with an error fails the job."""
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return rows.select("index", F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(body).alias("payload"))


def _numbered(split: str) -> Column:
    return F.concat(F.lit(f"{split}-"), F.lpad(F.col("index").cast("string"), 6, "0"))


def _picture(split: str, suffix: str = "") -> Column:
    return F.concat(F.lit(f"images/{split}/"), F.lpad(F.col("index").cast("string"), 6, "0"), F.lit(f"{suffix}.png"))


def single_label_records(rows: DataFrame, split: str, names: list[str]) -> DataFrame:
    """Pictures with one class id each."""
    rows = parsed(rows).withColumn("_label", decode_label(text_of(F.to_json(F.try_variant_get("_v", "$.label", "variant"))), names))
    plant = parse_plant_label("_label")
    return _record(
        rows, F.when(F.col("_label").isNull(), "picture without a label"), id=_numbered(split), image=_picture(split), label=F.col("_label"), split=canonical_split(F.lit(split)), crop=plant["crop"], disease=plant["disease"],
        template_origin=F.lit("source_authored"),
    )


def multi_label_records(rows: DataFrame, split: str, names: list[str]) -> DataFrame:
    """Pictures with a list of class ids; the label is the most common one, the earliest on ties."""
    rows = parsed(rows)
    ids = list_of(F.to_json(F.try_variant_get("_v", "$.objects.category", "variant")))
    rows = rows.withColumn("_labels", F.filter(F.transform(ids, lambda x: decode_label(x, names)), lambda x: F.coalesce(normalize_edges(x), F.lit("")) != ""))
    return _record(
        rows, F.when(F.size("_labels") == 0, "picture with missing object categories"), id=F.coalesce(text_of(pick("image_id")), _numbered(split)), image=_picture(split), label=mode_of_array(F.col("_labels")),
        all_labels=F.col("_labels"), split=canonical_split(F.lit(split)), template_origin=F.lit("source_authored"),
    )


def _pictures(count: int, split: str, prefix: str = "") -> Column:
    return F.array(*[F.concat(F.lit(f"images/{prefix}{split}/{prefix.replace('/', '-')}{split}-"), F.lpad(F.col("index").cast("string"), 6, "0"), F.lit(f"-{i + 1:02}.png")) for i in range(count)])


def vqa_source_records(rows: DataFrame, split: str, default_task: str | None = None, images: int = 1) -> DataFrame:
    """Questions and answers of any source; `images` is the number of picture columns."""
    rows = parsed(rows).withColumn("_q", normalize_edges(text_of(first_non_empty(*QUESTIONS)))).withColumn("_a", normalize_edges(text_of(first_non_empty(*ANSWERS))))
    pictures = _pictures(images, split)
    error = F.when(F.lit(images == 0), "record without pictures").when(F.col("_q") == "", "record without a question").when(F.col("_a") == "", "record without an answer")
    extra = {k: text_of(pick(k)) for k in ("crop", "disease", "pest", "question_type", "options")}
    return _record(
        rows, error, id=F.coalesce(text_of(pick("id", "question_id")), _numbered(split)), images=pictures, image=F.get(pictures, F.lit(0)), question=F.col("_q"), answer=F.col("_a"),
        split=canonical_split(F.coalesce(text_of(pick("split")), F.lit(split))), task_type=F.coalesce(F.lit(default_task).cast("string"), text_of(pick("task_type"))), template_origin=F.lit("source_authored"), **extra,
    )


def benchmark_records(rows: DataFrame, config: str, split: str, images: int = 1) -> DataFrame:
    """A benchmark's configuration: with a decision the task is to clarify or respond, else consultation; the track follows the configuration's name."""
    rows = parsed(rows).withColumn("_q", normalize_edges(text_of(first_non_empty(*TRACK_QUESTIONS)))).withColumn("_a", normalize_edges(text_of(first_non_empty(*TRACK_ANSWERS))))
    rows = rows.withColumn("_d", normalize_decision(text_of(pick("decision"))))
    pictures = _pictures(images, split, f"{config}/")
    error = F.when(F.lit(images == 0), "turn without pictures").when((F.col("_q") == "") | (F.col("_a") == ""), "turn without question or answer")
    return _record(
        rows, error, id=F.coalesce(text_of(pick("id")), _numbered(config)), images=pictures, image=F.get(pictures, F.lit(0)), question=F.col("_q"), answer=F.col("_a"), split=canonical_split(F.lit(split)),
        task_type=F.when(F.col("_d").isNotNull(), "clarify_or_respond").otherwise("consultation"), decision=F.col("_d"), management_keywords=list_of(first_non_empty(*GOALS)),
        benchmark_track=F.lit("mmmt" if config.lower().startswith("mmmt") else "mmst"), template_origin=F.lit("source_authored"),
    )


def archive_records(table: DataFrame, members: DataFrame, mode: str, fraction: float, default_task: str = "vqa", dataset: str = "archive") -> DataFrame:
    """Rows of an archive's table (`ord`, split, image_path, image_id, question, answer, question_type) with their pictures among its `members` (member).

    The first part of each split is taken, by `fraction` unless the mode is full. A picture is found by the lower case of
    its base name; one that isn't there, or an empty question or answer, fails the job. Rows of one picture share its path.
    """
    rows = table.withColumn("split", canonical_split(F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit("train"))))
    if download_mode(mode) == "partial":
        rows = prefix_quota(rows, "split", fraction)

    def base(path: Column) -> Column:
        return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-1)), F.lit(""))

    rows = rows.withColumn("_name", base(F.coalesce(F.nullif(F.col("image_path"), F.lit("")), F.col("image_id"))))
    found = members.select(F.lower(base(F.col("member"))).alias("_key"), "member").where(F.col("_key").rlike(r"\.(jpg|jpeg|png)$")).groupBy("_key").agg(F.max("member").alias("member"))
    rows = rows.join(found, F.lower("_name") == F.col("_key"), "left")
    first = rows.groupBy("split", "_key").agg(F.min_by("_name", "ord").alias("_stored"))
    rows = rows.join(first, ["split", "_key"], "left").withColumn("index", F.col("ord"))
    question, answer = normalize_edges("question"), normalize_edges("answer")
    error = F.when(F.col("_name") == "", "no path of a picture").when(F.col("member").isNull(), F.concat(F.lit("no such picture in the archive: "), "_name")).when((question == "") | (answer == ""), "no question or no answer")
    path = F.concat(F.lit("images/"), "split", F.lit("/"), "_stored")
    return _record(
        rows, error, id=F.concat(F.coalesce(F.nullif(F.col("image_id"), F.lit("")), F.lit(dataset)), F.lit("-"), F.lpad(F.col("index").cast("string"), 6, "0")), images=F.array(path), image=path,
        question=question, answer=answer, split=F.col("split"), task_type=F.lit(default_task), question_type=F.col("question_type"), template_origin=F.lit("source_authored"),
    )


def archive_members(path: str) -> list[str]:
    with zipfile.ZipFile(path) as archive:
        return archive.namelist()


def extract_pictures(archive: str, records: DataFrame, root: str) -> int:
    """Unpack the pictures of `records` (rows of archive_records) below `root`, each path once, and give their number.

    A picture is the archive's last member with its base name, whatever the case. An archive is one file that one process unpacks.
    """
    with zipfile.ZipFile(archive) as z:
        members = {os.path.basename(name).lower(): name for name in z.namelist()}
        n = 0
        for row in records.select(F.explode(list_of(F.get_json_object("payload", "$.images"))).alias("image")).distinct().toLocalIterator():
            target = os.path.join(root, row.image)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with z.open(members[os.path.basename(row.image).lower()]) as source, open(target, "wb") as f:
                shutil.copyfileobj(source, f)
            n += 1
    return n


def split_sizes(rows: DataFrame, split: str = "split") -> DataFrame:
    """split, n: rows by the canonical name of their split, train where there is none."""
    return rows.groupBy(canonical_split(F.coalesce(F.nullif(split, F.lit("")), F.lit("train"))).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def write_records(records: DataFrame, root: str) -> int:
    """Write the objects of `payload` as the data set's record file `records.jsonl`, a folder of parts, and give their number."""
    rows = records.select(F.col("payload").alias("value"))
    rows.write.mode("overwrite").text(os.path.join(root, "records.jsonl"))
    return records.count()


#: Materialisers by the kind of source that a data set's entry names. A new kind is added here.
MATERIALIZERS: dict[str, Callable[..., DataFrame]] = {
    "single_label": single_label_records,
    "multi_label": multi_label_records,
    "questions": vqa_source_records,
    "benchmark": benchmark_records,
    "archive": archive_records,
}


def materialize(kind: str, parts: Iterable[tuple[DataFrame, dict[str, Any]]], root: str) -> dict[str, Any]:
    """Record file of a data set from the rows of each of its splits or configurations, by the materialiser of its kind; an unknown kind is a KeyError."""
    made = [MATERIALIZERS[kind](rows, **options) for rows, options in parts]
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    return {"saved_rows": write_records(whole, root), "parts": len(made)}


def rewrite_split_lists(lines: DataFrame, prefix: str) -> DataFrame:
    """Lines of split lists (path, label_id) whose bare file names get a folder."""
    return lines.withColumn("path", F.when(F.instr("path", "/") == 0, F.concat(F.lit(prefix), "path")).otherwise(F.col("path")))


def looks_like_split_list(path: str) -> bool:
    """The first line that isn't blank names a .jpg."""
    if not os.path.isfile(path):
        return False
    with open(path, encoding="utf-8", errors="ignore") as f:
        return next((".jpg" in line.lower() for line in f if line.strip()), False)


def extract_once(archive: str, folder: str, marker: str) -> bool:
    """Unpack a tar or zip file unless its marker is there; true if it was unpacked now."""
    done = os.path.join(folder, marker)
    if os.path.exists(done):
        return False
    os.makedirs(folder, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            z.extractall(folder)
    else:
        with tarfile.open(archive) as t:
            t.extractall(folder, filter="data")
    open(done, "w").close()
    return True


class JoinedParts(io.RawIOBase):
    """The parts of a file that was cut, read one after the other as one stream."""

    def __init__(self, paths: Iterable[str]) -> None:
        self.paths = iter(paths)
        self.part: io.BufferedReader | None = None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.part is None:
                path = next(self.paths, None)
                if path is None:
                    return 0
                self.part = open(path, "rb")
            if n := self.part.readinto(into):
                return n
            self.part.close()
            self.part = None


def extract_parts_once(parts: Iterable[str], folder: str, marker: str) -> bool:
    """Unpack a tar file that was cut into parts, in the order of their names, without joining them on disk."""
    done = os.path.join(folder, marker)
    if os.path.exists(done):
        return False
    os.makedirs(folder, exist_ok=True)
    with tarfile.open(fileobj=io.BufferedReader(JoinedParts(sorted(parts))), mode="r|*") as t:
        t.extractall(folder, filter="data")
    open(done, "w").close()
    return True


def extract_rar_once(archive: str, folder: str, marker: str) -> bool:
    """Unpack a rar file by the first program on the path that can."""
    done = os.path.join(folder, marker)
    if os.path.exists(done):
        return False
    for program, arguments in (("unrar", ["x", "-o+", archive, folder + os.sep]), ("bsdtar", ["-xf", archive, "-C", folder]), ("7z", ["x", "-y", f"-o{folder}", archive])):
        if shutil.which(program):
            os.makedirs(folder, exist_ok=True)
            subprocess.run([program, *arguments], check=True, capture_output=True)
            open(done, "w").close()
            return True
    raise RuntimeError(f"no program here unpacks {archive}")


def acquire(specs: dict[str, DatasetSpec], materialize: Callable[[DatasetSpec], dict[str, Any]], root_of: Callable[[DatasetSpec], str], dry_run: bool = False) -> dict[str, dict[str, Any]]:
    """Status of each data set: downloaded, dry_run or manual_required. A source that fails becomes a manual slot and never ends the loop."""
    out: dict[str, dict[str, Any]] = {}
    for name, spec in specs.items():
        root = root_of(spec)
        if spec.source_type == "manual":
            manual_slot(root, name, "it has no source to download from")
            out[name] = {"status": "manual_required", "raw_dir": root}
        elif dry_run:
            out[name] = {"status": "dry_run", "raw_dir": root}
        else:
            try:
                made = materialize(spec)
                write_sidecar(root, {"dataset_name": name, "source_type": spec.source_type, "access": spec.access, "materialized": True, "manual_required": False, **made})
                out[name] = {"status": "downloaded", "raw_dir": root, **made}
            except Exception as problem:  # noqa: BLE001
                manual_slot(root, name, f"its download failed: {problem}")
                out[name] = {"status": "manual_required", "raw_dir": root, "reason": str(problem)}
    return out
