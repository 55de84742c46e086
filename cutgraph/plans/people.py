"""Persons described scene by scene become persons of the media item: alike ones are one, those met with a known face are that face."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sequential


def grouped(raw: DataFrame, least: float = 0.8, bonus: float = 0.1, near: int = 2) -> DataFrame:
    """(media_id, id, scene, g): each description joins the first group whose first member is alike, by cosine, or begins one.

    Descriptions of scenes at most ``near`` apart are alike by ``bonus`` more. ``raw`` is (media_id, id, scene, embedding), unit vectors; items are taken
    in the order of ``id``. One without a vector is alike to none.
    """

    def similar(a: dict, b: dict) -> float:
        x, y = a["embedding"], b["embedding"]
        return sum(p * q for p, q in zip(x, y, strict=True)) if x is not None and y is not None else -2.0

    core = lambda rows: [{"id": r["id"], "scene": r["scene"], "g": g} for r, g in zip(rows, sequential.merged_identities(rows, similar, least, bonus, near), strict=True)]
    vectors = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    return sequential.per_media(raw.select("media_id", "id", "scene", vectors), "media_id", ["id"], core, "media_id long, id long, scene long, g int")


def resolved(raw: DataFrame, faces: DataFrame, least: float = 0.8, bonus: float = 0.1, near: int = 2) -> DataFrame:
    """(media_id, id, person) for every description of ``raw``, by ``grouped``.

    A group is the person of ``faces`` (media_id, scene, person) in the first of its scenes that has one, of several the first by name. The groups without
    get the free letters in turn, person:A to person:Z and then person:A1 on, those of the item's faces being taken.
    """
    from ..session import cut

    groups = cut(grouped(raw, least, bonus, near))
    met = groups.join(faces.select("media_id", "scene", "person").distinct(), ["media_id", "scene"]).groupBy("media_id", "g").agg(F.min(F.struct("scene", "person")).alias("_first"))
    named = groups.select("media_id", "g").distinct().join(met, ["media_id", "g"], "left").select("media_id", "g", F.col("_first.person").alias("person"))
    taken = faces.groupBy("media_id").agg(F.collect_set("person").alias("_taken"))
    new = named.filter("person is null").withColumn("_k", F.row_number().over(Window.partitionBy("media_id").orderBy("g")))
    new = new.join(taken, "media_id", "left").withColumn("_taken", F.coalesce("_taken", F.expr("cast(array() as array<string>)")))
    letter = lambda i: F.concat(F.lit("person:"), F.char(65 + i % 26), F.when(i >= 26, F.floor(i / 26).cast("string")).otherwise(""))
    # of so many names one more than are taken is free for the k-th group
    names = F.transform(F.sequence(F.lit(0), F.col("_k") + F.size("_taken") - 1), letter)
    free = F.element_at(F.array_except(names, "_taken"), F.col("_k"))
    every = named.filter("person is not null").unionByName(new.select("media_id", "g", free.alias("person")))
    return groups.join(every, ["media_id", "g"]).select("media_id", "id", "person")
