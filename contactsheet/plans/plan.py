"""From reviewed findings to a validated action plan.  Nothing here changes a media file."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.numbering import running_sum, with_block
from ..params import DEFAULTS, ROTATE_JPEG, ROTATE_PIXELS, VIDEO
from ..storage import on_workers, written

#: Order of operations unless the user gives another.
OPERATIONS = ("dup-trash", "sim-trash", "orient-fix", "move-nonphotos", "rename-date", "fix-dates")
CATEGORY_OF = dict(zip(OPERATIONS, ("duplicates", "similar", "orientation", "non-photos", "rename", "dates")))

#: The highest suffix that a move of non-photos tries, as in the reference; other moves have no such limit.
MOST_MOVED = 9999


#: Width of the ranges of numbers that are counted together.
BLOCK = 65_536


def plan_minus_moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    return rows.join(moves.select("file_id"), "file_id", "left_anti")


def build_plan(findings: dict[str, DataFrame], reviewed: set[str], skipped: set[str] = frozenset(), order: tuple[str, ...] = ()) -> DataFrame:
    """place, op_key, file_id, path, old_value, new_value of reviewed, unskipped findings (file_id, path, old_value, new_value).

    Files that are selected for a move are neither renamed nor re-dated, even if moving itself is skipped.
    """
    parts = []
    for key, rows in findings.items():
        category = CATEGORY_OF[key]
        if category not in reviewed or category in skipped:
            continue
        if key in ("rename-date", "fix-dates") and "move-nonphotos" in findings:
            rows = plan_minus_moved(rows, findings["move-nonphotos"])
        place = (order.index(key) if key in order else 999) if order else OPERATIONS.index(key)
        parts.append(rows.select(F.lit(place).alias("place"), F.lit(key).alias("op_key"), "file_id", "path", F.col("old_value").cast("string").alias("old_value"), F.col("new_value").cast("string").alias("new_value")))
    if not parts:
        raise ValueError("nothing is reviewed")
    return reduce(DataFrame.unionByName, parts)


def plan_summary(plan: DataFrame, media: DataFrame) -> DataFrame:
    both = plan.join(media.select("file_id", "size"), "file_id")
    return both.groupBy("op_key").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


#: Fixed value: a stem that another name's number would make.
NUMBERED = r"^(.*)_([1-9]\d{0,8})$"


def _parent_name(name: Column) -> Column:
    """The name whose number makes this one; null if none does."""
    stem = X.stem(name)
    return F.when(stem.rlike(NUMBERED), F.concat(F.regexp_extract(stem, NUMBERED, 1), X.suffix(name)))


def _families(names: DataFrame) -> DataFrame:
    """dest_dir, name, family of wanted names (dest_dir, name) that one's number may make of another, named by the first."""
    linked = names.withColumn("up", _parent_name(F.col("name"))).where("up is not null")
    known = names.withColumnRenamed("name", "up")
    linked = written(linked.join(known, ["dest_dir", "up"], "left_semi").select("dest_dir", "name", "up"), "linked")
    tops = linked.select("dest_dir", F.col("up").alias("name")).distinct().join(linked, ["dest_dir", "name"], "left_anti").withColumn("up", F.col("name"))
    chain = written(linked.unionByName(tops), "chains")
    while True:  # each round doubles how far up a name looks
        above = chain.select("dest_dir", F.col("name").alias("up"), F.col("up").alias("top"))
        step = written(chain.join(above, ["dest_dir", "up"]).select("dest_dir", "name", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "chains")
        chain = step.drop("moved")
        if step.where("moved").limit(1).count() == 0:
            return chain.withColumnRenamed("up", "family")


def _one_by_one(most: int | None):
    """Targets of claims that come by family: first the names that are taken, then the claims in their order."""
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("dest_dir", pa.string()), ("name", pa.string()), ("target", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken, last = None, set(), {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["dest_dir"], r["family"]) != family:
                    family, taken, last = (r["dest_dir"], r["family"]), set(), {}
                if r["is_claim"] == 0:
                    taken.add(r["name"])
                    continue
                got = r["name"]
                if got in taken:
                    n = last.get(got, 0) + 1
                    while (tried := f"{r['stem']}_{n}{r['ext']}") in taken:
                        n += 1
                    last[got] = n - 1 if most is not None and n > most else n
                    got = None if most is not None and n > most else tried
                if got is not None:
                    taken.add(got)
                out.append((r["file_id"], r["path"], r["dest_dir"], r["name"], f"{r['dest_dir']}/{got}" if got is not None else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def _served_in_order(claims: DataFrame, existing: DataFrame, most: int | None) -> DataFrame:
    """Claims of families, strictly by file_id.  A family goes through one task, row by row: that is what the order asks."""
    on_workers(claims.sparkSession)
    wanted = written(claims.select("dest_dir", "name").distinct(), "wanted-names")
    family = _families(wanted)
    own = claims.join(family, ["dest_dir", "name"])
    there = existing.select(X.parent(F.col("path")).alias("dest_dir"), X.basename(F.col("path")).alias("base")).distinct()
    made = there.withColumn("name", F.explode(F.array_compact(F.array("base", _parent_name(F.col("base"))))))
    taken = made.join(family, ["dest_dir", "name"]).select("dest_dir", "family", F.col("base").alias("name")).distinct()
    line = own.select("dest_dir", "family", F.lit(1).alias("is_claim"), "file_id", "path", "name", X.stem(F.col("name")).alias("stem"), X.suffix(F.col("name")).alias("ext"))
    line = line.unionByName(taken.withColumn("is_claim", F.lit(0)), allowMissingColumns=True)
    served = line.repartition("dest_dir", "family").sortWithinPartitions("dest_dir", "family", "is_claim", "file_id").mapInArrow(_one_by_one(most), "file_id long, path string, dest_dir string, name string, target string")
    others = claims.join(family, ["dest_dir", "name"], "left_anti")
    return served.unionByName(allocate_targets(others, existing, most))


def allocate_targets(claims: DataFrame, existing: DataFrame, most: int | None = None, ref_compat: bool = False) -> DataFrame:
    """Where each claim (file_id, path, dest_dir, name) goes: the plain name if free, else the smallest free _n.

    Claims are served by file_id, those that get their plain name before all others, so which names are taken is known
    at once and no claim waits for another.  (Serving strictly one by one differs only where a claim's numbered name
    is the plain name of a later claim: here the later one gets it.  With `ref_compat` such names are served one by one.)
    Names of `existing` (path) are taken; a file in place already stays; beyond `most`, if given, a claim fails (null
    target).  A name that a large share of all claims want is numbered in blocks.
    """
    full = F.concat("dest_dir", F.lit("/"), "name")
    if ref_compat:
        moving = claims.where(F.col("path") != full).select("file_id", "path", "dest_dir", "name")
        stays = claims.where(F.col("path") == full).select("file_id", "path", "dest_dir", "name", full.alias("target"))
        return stays.unionByName(_served_in_order(moving, existing, most))
    stays = claims.where(F.col("path") == full).select("file_id", "path", "dest_dir", "name", full.alias("target"))
    rows = claims.where(F.col("path") != full).withColumn("_stem", X.stem(F.col("name"))).withColumn("_ext", X.suffix(F.col("name")))
    there = existing.select(F.col("path").alias("_path")).distinct()
    taken = rows.select("dest_dir", "name").distinct().join(there, F.concat("dest_dir", F.lit("/"), "name") == F.col("_path"), "left_semi").withColumn("_taken", F.lit(1))
    ranked = rows.join(taken, ["dest_dir", "name"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    ranked = running_sum(with_block(written(ranked, "wanted"), "file_id"), ["dest_dir", "name"], "_block", [F.col("file_id")], F.lit(1), "_rank")
    # Both tables are read several times from here on.
    ranked = written(ranked.withColumn("_k", F.col("_rank") - 1 + F.col("_taken")), "ranked")
    plain = ranked.where("_k = 0").select("file_id", "path", "dest_dir", "name", full.alias("target"))
    more = ranked.where("_k > 0").select("file_id", "path", "dest_dir", "name", "_stem", "_ext", "_k")
    # Numbers that are taken for each name: of n taken ones in order, the n-th free number lies behind all with t - i < k.
    names = there.select(F.col("_path").alias("p")).union(plain.select("target")).distinct()
    shape, base = r"^(.*)_([1-9]\d{0,8})(\.[^.]+)?$", X.basename(F.col("p"))
    part = lambda i: F.regexp_extract(base, shape, i)
    numbers = names.select(X.parent(F.col("p")).alias("dest_dir"), part(1).alias("_stem"), part(3).alias("_ext"), part(2).try_cast("int").alias("_t")).where("_t is not null")
    group, block = ["dest_dir", "_stem", "_ext"], lambda c: F.floor(F.col(c) / BLOCK)
    gaps = running_sum(numbers.withColumn("_block", block("_t")), group, "_block", [F.col("_t")], F.lit(1), "_i")
    gaps = gaps.withColumn("_d", F.col("_t") - F.col("_i"))
    line = more.select(*group, F.col("_k").cast("bigint").alias("_d"), F.lit(0).alias("_is"), F.struct("file_id", "path", "name").alias("_c"))
    line = line.unionByName(gaps.select(*group, "_d", F.lit(1).alias("_is"), F.lit(None).cast(line.schema["_c"].dataType).alias("_c")))
    # Taken numbers with t - i < k come before the claim of rank k: equal ones after it.
    served = running_sum(written(line.withColumn("_block", block("_d")), "claims"), group, "_block", [F.col("_d"), F.col("_is")], F.col("_is"), "_n").where("_is = 0")
    slot = F.col("_d") + F.col("_n")
    target = F.concat("dest_dir", F.lit("/"), "_stem", F.lit("_"), slot.cast("string"), "_ext")
    target = target if most is None else F.when(slot <= most, target)
    served = served.select("_c.file_id", "_c.path", "dest_dir", "_c.name", target.alias("target"))
    return stays.unionByName(plain).unionByName(served)


def move_plan(classified: DataFrame, media: DataFrame, base: str = DEFAULTS.base_dir) -> DataFrame:
    claims = classified.select("file_id", "path", F.concat(F.lit(f"{base}/_non_photos/"), "category").alias("dest_dir"), F.col("filename").alias("name"))
    return allocate_targets(claims, media, most=MOST_MOVED)


def location_move_plan(named: DataFrame, media: DataFrame, base: str = DEFAULTS.base_dir) -> DataFrame:
    """Files into the folder of their label; files already in Unknown without a place stay out of the plan."""
    claims = named.select("file_id", "path", F.concat(F.lit(f"{base}/"), "label").alias("dest_dir"), F.col("filename").alias("name"))
    return allocate_targets(claims.where(F.concat("dest_dir", F.lit("/"), "name") != F.col("path")), media)


def validate_renames(renames: DataFrame, media: DataFrame) -> DataFrame:
    """Status of each rename (file_id, path, new_path) against the catalog and the plan itself."""
    known = media.select("path").distinct()
    same = F.count("*").over(Window.partitionBy("new_path"))
    rows = renames.select("file_id", "path", "new_path", same.alias("_same"))
    rows = rows.join(known.select("path", F.lit(True).alias("_old")), "path", "left").join(known.select(F.col("path").alias("new_path"), F.lit(True).alias("_new")), "new_path", "left")
    # Statuses.
    status = F.when(F.col("_old").isNull(), "Source not found").when(F.col("_new").isNotNull() | (F.col("_same") > 1), "Target already exists").otherwise("ok")
    return rows.select("file_id", "path", "new_path", status.alias("status"))


def resolve_sources(requests: DataFrame, media: DataFrame) -> DataFrame:
    known = media.select("path").distinct().withColumn("_ok", F.lit(True))
    return requests.join(known, "path", "left").select("request_id", "path", F.when(F.col("_ok"), "ok").otherwise("File not found").alias("status"))


def date_fix_plan(mismatches: DataFrame) -> DataFrame:
    """Old and new time of change (seconds) of files whose target is an ISO text; bad texts are marked."""
    at = F.unix_micros(F.try_to_timestamp("target_date", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))) / 1e6
    return mismatches.select("file_id", "path", F.col("mtime_s").alias("old_s"), at.alias("new_s"), F.when(at.isNull(), "Invalid date").otherwise("ok").alias("status"))


def rotation_plan(detections: DataFrame) -> DataFrame:
    ext = F.col("extension")
    # What can't be rotated.
    how = F.when(~F.col("rotation").isin(90, 180, 270), F.concat(F.lit("Invalid rotation: "), F.col("rotation").cast("string")))
    how = how.when(ext.isin(*ROTATE_JPEG), "jpeg").when(ext.isin(*ROTATE_PIXELS), "pixels").when(ext.isin(*VIDEO), "video-metadata").otherwise(F.concat(F.lit("Unsupported format: "), ext))
    return detections.select("file_id", "path", "rotation", how.alias("strategy"))


def orientation_reset_plan(issues: DataFrame) -> DataFrame:
    return issues.select("file_id", "path", F.col("current_orientation").cast("string").alias("old_value"), F.lit("1").alias("new_value"))


def action_outcomes(statuses: DataFrame, key: str = "op_key") -> DataFrame:
    """Of each file whether its action succeeded, and the error of one that failed."""
    good = F.col("status") == "ok"
    return statuses.select(key, "file_id", "path", good.alias("success"), F.when(~good, F.col("status")).alias("error"))


def action_result(statuses: DataFrame, key: str = "op_key") -> DataFrame:
    return statuses.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("success_count"), F.count_if(F.col("status") != "ok").alias("failed_count"))


def review_stats(states: DataFrame, media: DataFrame, category: str) -> DataFrame:
    both = states.join(media.select("file_id", "size"), "file_id")
    return both.groupBy("state").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).select(F.lit(category).alias("category"), "state", "files", "bytes")
