"""Validation, classification and completeness as columns: rules give messages, rows with messages are quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CORE_FILES, ENUMS, ESCALATING, HUMAN, MAX_RETRIES, PROPRIETARY


def messages(rules: dict[str, Column]) -> Column:
    """Messages of the rules a row breaks; a rule is the condition that must hold, and null breaks it."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()]), lambda m: m.isNotNull())


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    return rows.select(*key, F.explode(messages(rules)).alias("message"))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their messages."""
    told = rows.withColumn("messages", messages(rules))
    return told.filter(F.size("messages") == 0).drop("messages"), told.filter(F.size("messages") > 0)


def item_rules(meta: str = "metadata") -> dict[str, Column]:
    get = lambda k: F.get_json_object(F.col(meta), f"$.{k}")
    return {"id has no module and name": get("id").rlike(r"^[A-Z][a-zA-Z]+\.[A-Z][a-zA-Z]+$"), "name is missing": F.trim(get("name")) != ""}


def recipe_rules(meta: str = "metadata") -> dict[str, Column]:
    get = lambda k: F.get_json_object(F.col(meta), f"$.{k}")
    counts = F.map_values(F.from_json(get("ingredients"), "map<string,double>"))
    return {"name is missing": F.trim(get("name")) != "", "result is missing": F.trim(get("result")) != "", "no ingredient with a count": F.exists(counts, lambda n: n > 0)}


def metadata_rules(meta: str = "metadata") -> dict[str, Column]:
    """Required fields of a structured object's metadata and the values they may have."""
    get = lambda k: F.get_json_object(F.col(meta), f"$.{k}")
    return {
        "item_type is missing": get("item_type").isNotNull(), "game_version is missing": get("game_version").isNotNull(), "base_id is missing": get("base_id").isNotNull(),
        "item_type is unknown": F.coalesce(get("item_type").isin(ENUMS["item_type"]), F.lit(True)), "game_version is unknown": F.coalesce(get("game_version").isin(ENUMS["game_version"]), F.lit(True)),
    }


def table_rules(table: str) -> dict[str, Column]:
    """The constraints of a relational table as rules."""
    return {
        "projects": {"mod_id has odd characters": F.col("mod_id").rlike(r"^[A-Za-z0-9_.-]+$")},
        "dependencies": {"a project depends on itself": F.coalesce(F.col("project_id") != F.col("dependent_id"), F.lit(True)), "dependency_type is unknown": F.col("dependency_type").isin(ENUMS["dependency_type"])},
        "users": {"role is unknown": F.col("role").isin(ENUMS["role"]), "username is missing": F.trim("username") != ""},
        "ingestion_runs": {"status is unknown": F.col("status").isin(ENUMS["run_status"]), "source_type is missing": F.col("source_type").isNotNull()},
    }.get(table, {})


#: Expected fields per kind of entity, in lower case without underscores.
EXPECTED = {
    "weapon": ["name", "type", "weight", "categories", "subcategory", "description", "icon", "conditionmax", "damagetiers"],
    "food": ["name", "type", "calories", "protein", "vitamin", "mineral", "water"],
    "clothing": ["name", "type", "blunt", "cut", "scratch", "tear"],
    "recipe": ["name", "result", "time", "category", "ingredients", "skillrequired"],
    "mob": ["name", "hp", "speed", "damage", "behavior", "spawnbiomes", "xp", "detectionradius"],
    "generic": ["name", "type", "weight"],
}


def completeness(kind: Column, keys: Column) -> Column:
    """Share of the kind's expected fields that are present; keys are compared in lower case and without underscores."""
    low = F.transform(keys, lambda k: F.replace(F.lower(k), F.lit("_"), F.lit("")))
    out = F.lit(None).cast("double")
    for name, want in EXPECTED.items():
        wanted = F.array(*[F.lit(w) for w in want])
        out = F.when(kind == name, F.size(F.array_intersect(low, wanted)) / F.lit(float(len(want)))).otherwise(out)
    return F.coalesce(out, F.size(F.array_intersect(low, F.array(*[F.lit(w) for w in EXPECTED["generic"]]))) / F.lit(float(len(EXPECTED["generic"]))))


def first_match(text: Column, table: list[tuple[str, list[str]]], default: str) -> Column:
    """The first name in the table one of whose words the text contains."""
    out = None
    for name, words in table:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


# Classes of items by words in their type, and the schema each class is measured by.
ITEM_CLASSES = [("weapon_melee", ["melee"]), ("weapon_firearm", ["weapon"]), ("food", ["food", "canned"]), ("clothing", ["clothing", "armor"]), ("vehicle", ["vehicle"]), ("building_material", ["building"])]
SCHEMA_OF_CLASS = {"weapon_melee": "weapon", "weapon_firearm": "weapon", "food": "food", "clothing": "clothing"}


# Forms of messages.
COMMANDS = {"stats": ["stats"], "survival": ["survie", "help_me_survive"], "recipe": ["recipe"], "moddoc": ["moddoc", "luaapi", "javaapi"], "search": ["search"]}
ITEM_QUESTION = r"(?i)stats?\s*(?:de\s*)?([a-z]+\.[a-z]+)"
INTENT_WORDS = [("recipe", ["recette", "craft", "artisanat"]), ("moddoc", ["moddoc", "lua api", "java api", "modding", "hook"])]


def intent(text: Column) -> Column:
    """What a message asks for: a slash command, an item's stats, then keywords, else a search."""
    t = F.lower(F.trim(text))
    out = None
    for name, commands in COMMANDS.items():
        hit = t.rlike(rf"^/({'|'.join(commands)})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(t.rlike(ITEM_QUESTION), "stats").otherwise(first_match(t, INTENT_WORDS, "search"))


def query_text(text: Column) -> Column:
    """The message without its slash command."""
    return F.trim(F.regexp_replace(F.trim(text), r"^/[A-Za-z_]+\s*", ""))


def item_id(text: Column) -> Column:
    """The item that a message names, as Module.Name, else null."""
    found = F.regexp_extract(text, r"\b([A-Z][a-zA-Z]+\.[A-Z][a-zA-Z]+)\b", 1)
    return F.when(found != "", found)


# Kinds of packages by words in a request.
MOD_TYPES = [
    ("item", ["arme", "weapon", "hache", "sword", "epée"]), ("feature", ["recette", "recipe", "craft", "cuisin", "meal"]), ("enemy", ["zombie", "ennemi", "enemy", "mob"]),
    ("vehicle", ["vehicle", "voiture", "car", "camion"]), ("ui", ["interface", "ui", "menu", "hud"]),
]


def mod_type(request: Column) -> Column:
    """What kind of package a request is for."""
    return first_match(F.lower(request), MOD_TYPES, "feature")


def mod_name(request: Column) -> Column:
    """The capitalised word after *mod*, else the request itself up to 64 characters."""
    found = F.regexp_extract(request, r"[Mm][Oo][Dd]\s+([A-Z][a-zA-Z0-9_-]+)", 1)
    return F.when(found != "", found).otherwise(F.left(F.trim(request), F.lit(64)))


def tier(errors: Column, fixes: Column, warnings: Column, changes: Column) -> Column:
    """Governance tier of a run: red for core files, closed dependencies or three fixes; orange for new recipes or changed
    items or more than one warning; else green. ``errors`` are the types of its errors."""
    red = F.arrays_overlap(errors, F.array(F.lit(CORE_FILES), F.lit(PROPRIETARY))) | (fixes >= 3)
    return F.when(F.coalesce(red, F.lit(False)), "red").when(changes | (warnings > 1), "orange").otherwise("green")


def should_escalate(retries: Column, errors: Column, limit: Column | None = None) -> Column:
    """Whether a run goes to a human: retries are spent, or an error asks for it."""
    asks = F.arrays_overlap(errors, F.array(*[F.lit(e) for e in [*ESCALATING, *HUMAN]]))
    return (retries >= (F.lit(MAX_RETRIES) if limit is None else limit)) | F.coalesce(asks, F.lit(False))


def escalation_reason(errors: Column) -> Column:
    """The first error that needs a human, else the first three kinds of error."""
    human = F.array_intersect(F.array(*[F.lit(e) for e in HUMAN]), errors)
    return F.when(F.size(human) > 0, F.concat(F.lit("critical: "), F.element_at(human, 1))).when(F.size(errors) > 0, F.array_join(F.array_distinct(F.slice(errors, 1, 3)), "; ")).otherwise("no error given")


def may_publish_alone(tier: Column) -> Column:
    return tier == "green"


def needs_approval(tier: Column) -> Column:
    return tier.isin("orange", "red")


def name_keys(name: Column) -> Column:
    """The forms under which a reference may name an entity."""
    low = F.lower(F.trim(name))
    return F.array_distinct(F.array(low, F.replace(low, F.lit(" "), F.lit("_")), F.replace(low, F.lit("_"), F.lit(" "))))


def broken_references(refs: DataFrame, ref: str, known: DataFrame, keys: list[str]) -> DataFrame:
    """References that match no known entity by key or display name, in any form; a hash join over the forms."""
    forms = None
    for k in keys:
        part = known.select(F.explode(name_keys(F.col(k))).alias("__form"))
        forms = part if forms is None else forms.union(part)
    wanted = refs.select(ref).distinct().select(ref, F.explode(name_keys(F.col(ref))).alias("__form"))
    met = wanted.join(forms.distinct(), "__form", "left_semi").select(ref).distinct()
    return refs.join(met, ref, "left_anti")


def mode(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The most frequent value; of equally frequent ones that first seen."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.col("n").desc(), "first_seen").limit(1)


def report(rows: DataFrame, checks: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """One row per check: an aggregate, and PASS up to the first limit, WARN up to the second, else FAIL."""
    one = rows.agg(*[c.alias(f"c{i}") for i, (c, _, _) in enumerate(checks.values())])
    parts = [F.struct(F.lit(name).alias("check"), F.col(f"c{i}").cast("double").alias("value"), F.when(F.col(f"c{i}") <= warn, "PASS").when(F.col(f"c{i}") <= fail, "WARN").otherwise("FAIL").alias("status")) for i, (name, (_, warn, fail)) in enumerate(checks.items())]
    return one.select(F.inline(F.array(*parts)))


def return_code(report: DataFrame) -> DataFrame:
    """1 if a check fails, 0 if passes are at least half, else -1."""
    n = lambda s: F.count_if(F.col("status") == s)
    return report.agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed")).withColumn("code", F.when(F.col("failed") > 0, 1).when(F.col("passed") >= F.col("warned") + F.col("failed"), 0).otherwise(-1))
