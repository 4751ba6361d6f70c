"""What artefacts were made from and whether they may be used: each rule gives every row a state, and what refuses says so.

Rules are CASE expressions over equi joins by name, so a listing of any size is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_state(name: Column, found: Column, recorded: Column, digest: Column, saved: Column, modified: Column) -> Column:
    """How far a cache can be trusted to be the one a checkpoint was trained against. Only a digest proves; a newer file is merely not ruled out."""
    return (
        F.when(name.isNull(), "none needed")
        .when(~found, "missing")
        .when(recorded.isNotNull(), F.when(digest == recorded, "verified").otherwise("rebuilt"))
        .when(saved.isNull(), "unknown")
        .when(modified > saved, "newer")
        .otherwise("plausible")
    )


def bank_state(whole: Column, name: Column, found: Column, rows: Column) -> Column:
    """Which rows an evaluation may search: all by request, all of a legacy checkpoint, those recorded, or none because something is gone."""
    return F.when(whole, "whole by request").when(name.isNull(), "whole, legacy").when(~found, "refused: file missing").when(rows.isNull(), "refused: no rows recorded").otherwise("recorded")


def stage_states(stages: DataFrame, stamps: DataFrame) -> DataFrame:
    """stage and state from stamps (stage, name, recorded, now): legacy without any record, missing if something recorded is gone, changed, or satisfied."""
    per = stamps.groupBy("stage").agg(
        F.count("recorded").alias("known"), F.count_if(F.col("recorded").isNotNull() & F.col("now").isNull()).alias("gone"),
        F.count_if(F.col("now") != F.col("recorded")).alias("other"),
    )
    known = F.coalesce("known", F.lit(0))
    state = F.when(known == 0, "legacy").when(F.col("gone") > 0, "missing").when(F.col("other") > 0, "changed").otherwise("satisfied")
    return stages.join(per, "stage", "left").select("stage", state.alias("state"))


def error_caches(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """tag and file: which cached errors stand for a tag.

    checkpoints: tag, stamp, inputs (null without any), saved; files: tag, file, stamp and inputs (null where unstamped), modified. The file that
    bears the checkpoint's own stamps; else an unstamped one that is newer, if the checkpoint has no stamped inputs; without a checkpoint, the newest.
    """
    c = checkpoints.select("tag", F.col("stamp").alias("want"), F.col("inputs").alias("want_inputs"), "saved", F.lit(True).alias("have"))
    j = files.join(c, "tag", "left")
    own = (F.col("stamp") == F.col("want")) & F.col("inputs").eqNullSafe(F.col("want_inputs"))
    old = F.col("stamp").isNull() & F.col("want_inputs").isNull() & (F.col("modified") > F.col("saved"))
    grade = F.when(F.col("have").isNull(), F.lit(1)).when(own, F.lit(3)).when(old, F.lit(2))
    ranked = j.withColumn("grade", grade).where("grade is not null")
    return ranked.groupBy("tag").agg(F.max_by("file", F.struct("grade", "modified", "file")).alias("file"))


def split_column(df: DataFrame, mode: str, modes: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and split, the assignment of a mode, which has a column of its own name."""
    if mode not in modes:
        raise ValueError(f"no split mode {mode!r}; there are {', '.join(sorted(modes))}")
    name = f"split_{mode}"
    if name not in df.columns:
        raise ValueError(f"the table has no column {name!r}; write every mode's assignment first")
    return df.select(*keep, F.col(name).alias("split"))


def resplit(rows: DataFrame, legacy: str, modes: list[str]) -> DataFrame:
    """mode, agreement and verdict: a legacy column may be overwritten only if some mode makes exactly the same one."""
    shares = rows.agg(*(F.avg((F.col(m) == F.col(legacy)).cast("double")).alias(m) for m in modes))
    s = shares.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("agreement")) for m in modes))).alias("s"), F.greatest(*modes).alias("best") if len(modes) > 1 else F.col(modes[0]).alias("best"))
    verdict = F.when(F.col("s.agreement") == 1, "same").when(F.col("best") == 1, "other").otherwise("refused")
    return s.select("s.mode", "s.agreement", verdict.alias("verdict"))


def prefix_faults(joined: DataFrame, own: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of joined (key, v) whose first width numbers aren't own's vector: every row is compared, not a sample."""
    j = joined.select(key, F.slice("v", 1, width).alias("a")).join(own.select(key, F.col("v").alias("b")), key, "left")
    return j.where(F.col("b").isNull() | (F.size("b") != width) | ~F.col("a").eqNullSafe(F.col("b"))).select(key)


def join_state(a: Column, b: Column) -> Column:
    """Whether two caches may be joined by position: both have to say which rows they hold, and the same."""
    return F.when(a.isNull(), "refused: first unstamped").when(b.isNull(), "refused: second unstamped").when(a != b, "refused: other rows").otherwise("joined")


def renderer_state(made_by: Column, current: Column) -> Column:
    """Tiles count only if the renderer that is asked made them."""
    return F.when(made_by.isNull(), "unstamped").when(made_by == current, "current").otherwise("foreign")


def fingerprint(sources: DataFrame, name: str, content: str) -> DataFrame:
    """One digest of named sources in order of their names: each gives name, length and digest, so bytes can't move from one to the next unseen."""
    part = F.concat_ws("|", F.col(name), F.octet_length(content).cast("string"), F.sha2(F.col(content).cast("string"), 256))
    return sources.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(part))), 256).alias("digest"))


def resolve_rows(artefacts: DataFrame, metas: DataFrame, release: int) -> DataFrame:
    """stem and source: where an unstamped artefact's (stem, n, own_n, rows_n, rows_max) ids come from.

    Its own metadata of that length; else, of the metadata (meta, len) whose name begins its own, the longest name: its rows through a row index, or as many as
    it has; else the release through an index, or as it is; else the release and the one extension that makes up the length.
    """
    prefix = artefacts.select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda k: F.substring(F.col("stem"), F.lit(1), k))).alias("meta"))
    parents = prefix.join(metas, "meta").join(artefacts, "stem")
    fits = (F.coalesce(F.col("rows_n") == F.col("n"), F.lit(False)) & (F.col("rows_max") < F.col("len"))) | (F.col("len") == F.col("n"))
    best = parents.where(fits).groupBy("stem").agg(F.max_by(F.struct("meta", "len"), F.length("meta")).alias("p"))
    more = metas.groupBy((F.col("len") + release).alias("n")).agg(F.count("*").alias("several"), F.min("meta").alias("ext"))
    indexed = F.coalesce(F.col("rows_n") == F.col("n"), F.lit(False))
    source = (
        F.when(F.col("own_n") == F.col("n"), "own")
        .when(F.col("p").isNotNull() & indexed & (F.col("rows_max") < F.col("p.len")), F.concat(F.lit("index into "), "p.meta"))
        .when(F.col("p").isNotNull(), F.concat(F.lit("rows of "), "p.meta"))
        .when(indexed & (F.col("rows_max") < release), "index into the release")
        .when(F.col("n") == release, "release")
        .when(F.col("several") == 1, F.concat(F.lit("release and "), "ext"))
        .when(F.col("several") > 1, "by content")
        .otherwise("unknown")
    )
    return artefacts.join(best, "stem", "left").join(more, "n", "left").select("stem", source.alias("source"))


def refusals(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order, comma-joined."""
    return F.array_join(F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull()), ",")


def training_rules() -> dict[str, Column]:
    """Arguments that a training run would accept and silently misuse. soft is a comma-separated list of temperatures."""
    soft = F.exists(F.split("soft", ","), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)) > 0)
    return {
        "neighbours": F.col("retr") & (F.col("retr_k") <= 0),
        "drop range": (F.col("retr_drop") < 0) | (F.col("retr_drop") >= 1),
        "drop alone": (F.col("retr_drop") > 0) & ~F.col("retr"),
        "sink count": F.col("sink_k") < 1,
        "sink alone": (F.col("sink_k") > 1) & (F.col("neg") <= 0),
        "soft unread": F.exists(F.split("soft", ","), lambda x: x.try_cast("double").isNull()),
        "soft with sink": ~F.exists(F.split("soft", ","), lambda x: x.try_cast("double").isNull()) & soft & (F.col("neg") > 0),
    }
