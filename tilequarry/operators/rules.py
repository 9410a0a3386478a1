"""Where an image's output goes: ordered rules of patterns, base directories and templates, all of them rows of tables.

The first rule of an image's group whose pattern matches the name from its start on decides. A rule whose base directory is
not there is an error; one that asks for a directory below the base that ends with a named part of the name takes the first
such directory, and gives way to the next rule where there is none. `${name}` in a template stands for a named part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchored(pattern: Column) -> Column:
    return F.concat(F.lit("^(?:"), pattern, F.lit(")"))


def part(name: Column, pattern: Column, number: Column) -> Column:
    return F.call_function("regexp_extract", name, anchored(pattern), number)


def expand(template: Column, name: Column, pattern: Column, groups: Column) -> Column:
    """The template with every named part of the name; groups: array of (name, number)."""
    put = lambda held, g: F.replace(held, F.concat(F.lit("${"), g["name"], F.lit("}")), part(name, pattern, g["number"]))
    return F.aggregate(groups, template, put)


def children(dirs: DataFrame) -> DataFrame:
    """(base, path, leaf) of every directory that lies in another; hidden ones are left out."""
    below = dirs.select("path", F.regexp_extract("path", "^(.*)/([^/]+)$", 1).alias("base"), F.regexp_extract("path", "^(.*)/([^/]+)$", 2).alias("leaf"))
    return below.where("leaf <> '' AND leaf NOT LIKE '.%'")


def resolve_directories(images: DataFrame, rules: DataFrame, dirs: DataFrame, strict: bool = False) -> DataFrame:
    """Per image: image_id, dir (null without a rule) and status (found, no_rule or no_base).

    images: image_id, group_id, image_name. rules: group_id, pos, pattern, base, template, suffix (number of the
    part that the directory's name ends with, null for none), groups; they are few. dirs: path of every directory.
    With strict a missing base directory raises.
    """
    hit = images.select("image_id", "group_id", "image_name").join(F.broadcast(rules), "group_id")
    hit = hit.where(F.call_function("rlike", F.col("image_name"), anchored(F.col("pattern"))))
    bases = rules.select("base").distinct().join(dirs.select(F.col("path").alias("base")).distinct().withColumn("there", F.lit(True)), "base")
    hit = hit.join(F.broadcast(bases), "base", "left")
    hit = hit.withColumn("ending", F.when(F.col("suffix").isNotNull(), part(F.col("image_name"), F.col("pattern"), F.col("suffix"))))
    # Endings repeat over images, so each is looked up once among the directories of its base.
    asked = hit.where("ending IS NOT NULL").select("base", "ending").distinct()
    found = asked.join(children(dirs), "base").where(F.expr("endswith(leaf, ending)")).groupBy("base", "ending").agg(F.min("path").alias("below"))
    hit = hit.join(found, ["base", "ending"], "left")
    outcome = F.when(F.col("there").isNull(), "no_base").when(F.col("ending").isNotNull() & F.col("below").isNull(), "next").otherwise("found")
    place = F.concat(F.coalesce("below", "base"), F.lit("/"), expand(F.col("template"), F.col("image_name"), F.col("pattern"), F.col("groups")))
    first = hit.withColumn("status", outcome).where("status <> 'next'").groupBy("image_id").agg(F.min_by(F.struct("status", F.when(F.col("status") == "found", place).alias("dir"), "base"), "pos").alias("r"))
    status = F.coalesce("r.status", F.lit("no_rule"))
    if strict:
        status = F.when(status == "no_base", F.raise_error(F.concat(F.lit("no such base directory: "), F.col("r.base")))).otherwise(status)
    return images.select("image_id").join(first, "image_id", "left").select("image_id", F.col("r.dir").alias("dir"), status.alias("status"))


def match_names(files: DataFrame, images: DataFrame) -> DataFrame:
    """(path, candidates, image_id, status): files (path, stem) paired with the only image (image_id, istem) of their stem.

    A file whose stem no image has goes by stems that begin its own or that its own begins, found by equality of beginnings.
    Files and images meet as distinct stems with their counts, so the pairs of a stem that many share are never made.
    """
    total = [F.sum("n").alias("n"), F.min("m").alias("m")]
    begin = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    held = images.groupBy(F.col("istem").alias("stem")).agg(F.count("image_id").alias("n"), F.min("image_id").alias("m"))
    asked = files.select("stem").distinct()
    rest = asked.join(held, "stem", "left_anti")
    shorter = rest.select(F.col("stem").alias("own"), begin("stem").alias("stem")).join(held, "stem").select(F.col("own").alias("stem"), "n", "m")
    longer = rest.join(held.select(begin("stem").alias("stem"), "n", "m").groupBy("stem").agg(*total), "stem")
    found = asked.join(held, "stem").unionByName(shorter).unionByName(longer).groupBy("stem").agg(*total)
    out = files.join(found, "stem", "left").groupBy("path").agg(*total).withColumn("candidates", F.coalesce("n", F.lit(0)).cast("long"))
    one = F.col("candidates") == 1
    return out.select("path", "candidates", F.when(one, F.col("m")).alias("image_id"), F.when(one, "pair").otherwise("problem").alias("status"))
