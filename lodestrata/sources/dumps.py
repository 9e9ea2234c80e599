"""Entity dumps: JSON maps or lists of open records per category, normalised through aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COLLECTIONS, DEFAULT_COLLECTION
from ..operators.chunking import entity_split
from ..operators.quality import ITEM_CLASSES, SCHEMA_OF_CLASS, completeness, first_match

#: Names under which a field may be stored.
ALIASES = {
    "name": ["Name", "name", "DisplayName", "displayName"], "type": ["Type", "type"], "weight": ["weight", "Weight"],
    "description": ["description", "Description"], "category": ["Category", "category", "Categories", "categories"],
    "result": ["Result", "result", "result_item", "resultItem"], "time": ["Time", "time"], "ingredients": ["ingredients", "Ingredients", "Inputs"],
    "skill": ["SkillRequired", "skill_required", "skillRequired"], "tools": ["ToolsRequired", "tools_required"],
    "hp": ["HP", "hp", "health", "HealthPoints"], "speed": ["Speed", "speed"], "damage": ["Damage", "damage"], "behavior": ["Behavior", "behavior"],
    "biomes": ["SpawnBiomes", "spawn_biomes", "Biomes", "biomes"], "xp": ["XP", "xp"], "drops": ["Drops", "drops"],
}
CARDS = {
    "items": ["name", "type", "weight", "category", "description"],
    "recipes": ["name", "result", "time", "category", "ingredients", "skill", "tools"],
    "mobs": ["name", "hp", "speed", "damage", "behavior", "biomes", "xp", "drops"],
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """category, key and record (JSON text) of a dump: a folder with a file per category, or one file keyed by category.

    A category is a map of records or a list of them (the index is the key). Keys that begin with ``_``, records that
    aren't objects and categories that are neither are left out.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    named = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("stem"), F.try_parse_json("value").alias("v"))
    top = named.selectExpr("stem", "v", "schema_of_variant(v) like 'OBJECT<%' as is_map")
    known = list(COLLECTIONS)
    as_map = F.expr("try_variant_get(v, '$', 'map<string,variant>')")
    parts = top.select("stem", F.when(F.col("is_map"), as_map).alias("m"), "v")
    # one file keyed by category, if any of its keys is one
    keyed = F.exists(F.map_keys("m"), lambda k: F.lower(k).isin(known)) & ~F.lower("stem").isin(known)
    whole = parts.filter(F.coalesce(keyed, F.lit(False))).select(F.explode("m").alias("category", "v"))
    single = parts.filter(~F.coalesce(keyed, F.lit(False))).select(F.col("stem").alias("category"), "v")
    both = whole.unionByName(single).filter(~F.col("category").startswith("_"))
    from_map = both.select("category", F.explode(F.expr("try_variant_get(v, '$', 'map<string,variant>')")).alias("key", "r"))
    from_list = both.select("category", F.posexplode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("pos", "r")).select("category", F.col("pos").cast("string").alias("key"), "r")
    rows = from_map.unionByName(from_list).filter(~F.col("key").startswith("_") & (F.col("key") != ""))
    return rows.selectExpr("category", "key", "r").filter("schema_of_variant(r) like 'OBJECT<%'").select("category", "key", F.to_json("r").alias("record"))


def field(name: str, record: str = "record") -> Column:
    """The first alias that isn't null; 0 and false count."""
    return F.coalesce(*[F.get_json_object(record, f"$.{a}") for a in ALIASES.get(name, [name])])


def collection(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in COLLECTIONS.items() for x in p]), F.lower(category)), F.lit(DEFAULT_COLLECTION))


def keys_of(name: str) -> Column:
    """Keys of a map field, or a list field's values (its objects' names)."""
    raw = field(name)
    as_map = F.map_keys(F.from_json(raw, "map<string,string>"))
    items = F.transform(F.from_json(raw, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.item"), F.get_json_object(x, "$.name"), x))
    return F.when(raw.startswith("{"), as_map).when(raw.startswith("["), items).otherwise(F.array().cast("array<string>"))


def normalise(dump: DataFrame) -> DataFrame:
    """collection, chunk_id, text card, metadata, class, references and completeness of each record."""
    out = dump.withColumn("collection", collection(F.col("category")))
    line = lambda f: F.when(field(f).isNotNull(), F.concat(F.lit(f"{f}: "), field(f)))
    card = None
    category = F.lower(F.col("category"))
    shape = F.when(category == "recipes", "recipes").when(category == "mobs", "mobs").when(F.col("collection") == "items", "items").otherwise("open")
    for name, fields in CARDS.items():
        text = F.concat_ws("\n", F.coalesce(field("name"), F.col("key")), *[line(f) for f in fields[1:]])
        card = F.when(shape == name, text) if card is None else card.when(shape == name, text)
    pairs = F.map_entries(F.from_json("record", "map<string,string>"))
    generic = F.concat_ws("\n", F.coalesce(field("name"), F.col("key")), F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))
    kind = first_match(F.lower(F.coalesce(field("type"), F.lit(""))), ITEM_CLASSES, "generic")
    kind = F.when(shape == "recipes", "recipe").when(shape == "mobs", "mob").otherwise(kind)
    measured = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SCHEMA_OF_CLASS.items() for x in p]), kind), kind)
    keys = F.json_object_keys("record")
    return out.select(
        "collection", F.concat_ws(".", "category", "key").alias("chunk_id"), "key", F.coalesce(field("name"), F.col("key")).alias("name"), card.otherwise(generic).alias("text"),
        F.col("record").alias("metadata"), kind.alias("class"), F.size(keys).alias("fields_count"), F.round(completeness(measured, keys), 6).alias("completeness"),
        keys_of("ingredients").alias("ingredient_refs"), field("result").alias("result_ref"), F.sha2("record", 256).alias("content_hash"),
    )


def chunks(normalised: DataFrame, max_words: int = 800) -> DataFrame:
    """The rows of ``normalise``, a card of over ``max_words`` words in pieces that each begin with its first line. The
    first piece keeps the entity's id; ``piece`` numbers them and ``split`` tells that there are more."""
    pieces = normalised.withColumn("__parts", entity_split(F.col("text"), max_words)).withColumn("split", F.size("__parts") > 1)
    out = pieces.select("*", F.posexplode("__parts").alias("piece", "__text")).withColumn("text", F.col("__text")).drop("__parts", "__text")
    return out.withColumn("chunk_id", F.when(F.col("piece") == 0, F.col("chunk_id")).otherwise(F.concat_ws("#", "chunk_id", "piece")))


def structured_chunks(objects: DataFrame) -> DataFrame:
    """Two chunks of each structured object: the full card and, if it has specific data, its stats."""
    full = F.struct(F.lit("full").alias("part"), F.concat_ws("\n", "display_name", "description", F.concat_ws(", ", "tags")).alias("text"))
    stats = F.struct(F.lit("stats").alias("part"), F.concat_ws("\n", F.col("display_name"), F.array_join(F.transform(F.map_entries("game_specific"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")).alias("text"))
    parts = F.when(F.size("game_specific") > 0, F.array(full, stats)).otherwise(F.array(full))
    return objects.withColumn("p", F.explode(parts)).select(F.concat_ws("::", "base_id", "p.part").alias("chunk_id"), "base_id", "item_type", "game_version", "p.part", "p.text")
