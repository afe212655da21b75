"""Event schemas: definition files resolved to tables, and events checked against them.

A definition says what it adds to the one that it extends, to the files that it includes and to the dictionary of attributes. Each such
saying gets a rank, and for each attribute of a class or object the saying of highest rank holds, setting by setting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.guard import json_depth

# Types of the public event schema that aren't objects, and those of whole numbers.
SIMPLE = ("boolean_t", "bytestring_t", "datetime_t", "email_t", "file_hash_t", "file_name_t", "float_t", "hostname_t", "integer_t", "ip_t", "json_t", "long_t", "mac_t", "port_t", "process_name_t", "resource_uid_t", "string_t", "subnet_t", "timestamp_t", "url_t", "username_t", "uuid_t")
WHOLE = ("integer_t", "long_t", "port_t", "timestamp_t")
#: Attributes of an event that no class declares.
ENVELOPE = ("unmapped", "raw_data")
#: Objects below this level may lack required attributes.
REQUIRED_DEPTH = 2

_FILE = "name string, extends string, caption string, category string, uid int, attributes map<string,string>"
_SPEC = "type string, requirement string, is_array boolean, caption string, uid int, enum map<string,struct<caption:string>>"
#: A schema of more attributes than this isn't broadcast; the public one has some ten thousand.
MOST_BROADCAST = 200_000
#: After all includes of the same file.
_OWN = 1 << 30


@dataclass
class Schema:
    """``classes``: class_uid, class_name, caption, category, category_uid. ``attributes``: owner (``class:4001`` or ``object:user``),
    attribute, type, requirement, is_array, enum (captions by value), object (the object of its type, or null)."""

    classes: DataFrame
    attributes: DataFrame

    def kept(self, path: str) -> Schema:
        """The same, written to a folder that driver and executors share: checks look it up at every level."""
        read = lambda name, df: (df.write.parquet(f"{path}/{name}"), df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}"))[1]
        return Schema(read("classes", self.classes), read("attributes", self.attributes))


def definition_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the JSON files below a folder; paths begin at the folder."""
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring_index(whole, f"{base}/", -1).alias("path"), F.col("value").alias("text"))


def parsed_files(files: DataFrame) -> DataFrame:
    """Definition files by kind: event, object, or part (what others include), and the extension that they come from ('' for none)."""
    d = F.from_json("text", _FILE)
    kind = F.when(F.col("path").rlike(r"^(extensions/[^/]+/)?events/"), "event").when(F.col("path").rlike(r"^(extensions/[^/]+/)?objects/"), "object").otherwise("part")
    return files.select("path", kind.alias("kind"), F.regexp_extract("path", r"^extensions/([^/]+)/", 1).alias("extension"), d.alias("d")).select("path", "kind", "extension", "d.*").withColumn("attributes", F.coalesce("attributes", F.expr("map()")))


def settings(files: DataFrame, *keep: str) -> DataFrame:
    """One row for each attribute that a file itself describes: its settings as they stand there."""
    return files.select(*keep, F.explode("attributes").alias("attribute", "spec")).filter("attribute <> '$include'").select(*keep, "attribute", F.from_json("spec", _SPEC).alias("s"))


def lineages(named: DataFrame) -> DataFrame:
    """(kind, owner, at, distance): each definition with itself and all that it extends."""
    return named.sparkSession.sql(
        "WITH RECURSIVE up(kind, owner, at, distance) AS (SELECT kind, name, name, 0 FROM {d} UNION ALL "
        "SELECT u.kind, u.owner, d.extends, u.distance + 1 FROM up u JOIN {d} d ON d.kind = u.kind AND d.name = u.at AND d.extends <> d.name JOIN {d} p ON p.kind = d.kind AND p.name = d.extends) SELECT * FROM up",
        d=named.select("kind", "name", "extends"),
    )


def inclusions(files: DataFrame) -> DataFrame:
    """(path, target, place, profile): the files that a file includes, through others too. Later places win; a profile anywhere on the way makes attributes optional."""
    listed = files.select("path", F.posexplode(F.from_json(F.try_element_at("attributes", F.lit("$include")), "array<string>")).alias("n", "target"))
    return files.sparkSession.sql(
        "WITH RECURSIVE inc(path, target, place, profile) AS (SELECT path, target, array(n), startswith(target, 'profiles/') FROM {i} UNION ALL "
        "SELECT c.path, i.target, concat(c.place, array(i.n)), c.profile OR startswith(i.target, 'profiles/') FROM inc c JOIN {i} i ON i.path = c.target) SELECT * FROM inc",
        i=listed,
    )


def compiled(files: DataFrame) -> Schema:
    """The schema that definition files, (path, text), describe.

    A class is an event definition with a uid and, of its own or inherited, a category other than ``other``; its uid is extension * 100000 + category *
    1000 + uid. What an attribute's definition leaves open comes from the nearest definition that is extended, then the dictionary; the type is ``string_t`` and the
    requirement ``optional`` if nothing says otherwise. Definitions of an extension replace events of the same name and add to objects of the same name.
    Unknown parents and includes are passed over; definitions that extend each other in a circle are an error.
    """
    files = parsed_files(files)
    own_name = F.coalesce("name", F.when((F.col("kind") == "object") & (F.col("extension") != ""), F.col("extends")))
    owned = files.filter("kind <> 'part'").withColumn("owner", own_name).filter("owner IS NOT NULL AND (extension = '' OR kind = 'object' OR uid IS NOT NULL)")
    place = F.row_number().over(Window.partitionBy("kind", "owner").orderBy(F.desc(F.when(F.col("kind") == "event", F.col("extension"))), "extension", "path")) - 1
    owned = owned.withColumn("patch", place).filter("kind = 'object' OR patch = 0")
    named = owned.filter("patch = 0").drop("name").withColumnRenamed("owner", "name")
    chain = lineages(named)

    told = settings(files, "path")
    included = inclusions(files).join(told.withColumnRenamed("path", "target"), "target")
    requirement = F.when(F.col("profile"), F.lit("optional")).otherwise(F.col("s.requirement"))
    said = told.select("path", F.array(F.lit(_OWN)).alias("place"), "attribute", "s", F.col("s.requirement").alias("requirement"), F.lit(True).alias("own"))
    said = said.unionByName(included.select("path", F.concat("place", F.array(F.lit(_OWN))).alias("place"), "attribute", "s", requirement.alias("requirement"), F.lit(False).alias("own")))
    at = owned.select("kind", F.col("owner").alias("at"), "path", "patch")
    ranked = chain.join(at, ["kind", "at"]).join(said, "path").filter("patch = 0 OR own").withColumn("rank", F.struct(-F.col("distance"), "patch", "place"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank")))
    ranked = ranked.select("kind", "owner", "attribute", "rank", F.col("s.type").alias("type"), "requirement", F.col("s.is_array").alias("is_array"), F.col("s.enum").alias("enum"))
    merged = ranked.groupBy("kind", "owner", "attribute").agg(*[last(c).alias(c) for c in ("type", "requirement", "is_array", "enum")])

    words = settings(files.filter("path RLIKE '^(extensions/[^/]+/)?dictionary[.]json$'"), "path").groupBy("attribute").agg(F.min_by("s", "path").alias("w"))
    captions = lambda e: F.coalesce(F.transform_values(e, lambda _, v: F.coalesce(v["caption"], F.lit(""))), F.expr("cast(map() as map<string,string>)"))
    merged = merged.join(words, "attribute", "left").withColumn("e", captions(F.col("enum"))).withColumn("type", F.coalesce("type", "w.type", F.lit("string_t")))
    enum = F.map_concat(F.map_filter(captions(F.col("w.enum")), lambda k, _: ~F.map_contains_key("e", k)), F.col("e"))
    target = F.when(F.col("type").endswith("_t") & ~F.col("type").isin(*SIMPLE), F.expr("left(type, length(type) - 2)")).otherwise(F.col("type"))
    attributes = merged.select("kind", "owner", "attribute", "type", F.coalesce("requirement", F.lit("optional")).alias("requirement"), (F.coalesce("is_array", F.lit(False)) | F.coalesce("w.is_array", F.lit(False))).alias("is_array"), enum.alias("enum"), target.alias("target"))
    objects = named.filter("kind = 'object'").select(F.col("name").alias("target"), F.col("name").alias("object"))
    attributes = attributes.join(objects, "target", "left").drop("target")

    uids = settings(files.filter("path = 'categories.json'")).select(F.col("attribute").alias("category"), F.col("s.uid").alias("category_uid"))
    extensions = files.filter("path RLIKE '^extensions/[^/]+/extension[.]json$'").select("extension", F.col("uid").alias("extension_uid"))
    near = chain.filter("kind = 'event'").join(named.filter("kind = 'event' AND category <> 'other'").select(F.col("name").alias("at"), "category"), "at").groupBy(F.col("owner").alias("name")).agg(F.min_by("category", "distance").alias("category"))
    classes = named.filter("kind = 'event' AND uid IS NOT NULL").drop("category").join(near, "name").join(uids, "category").join(extensions, "extension", "left")
    classes = classes.select((F.coalesce("extension_uid", F.lit(0)) * 100_000 + F.col("category_uid") * 1000 + F.col("uid")).alias("class_uid"), F.col("name").alias("class_name"), F.coalesce("caption", "name").alias("caption"), "category", "category_uid")
    of_class = attributes.filter("kind = 'event'").join(classes.select(F.col("class_name").alias("owner"), "class_uid"), "owner").withColumn("owner", F.concat(F.lit("class:"), "class_uid")).drop("class_uid")
    of_object = attributes.filter("kind = 'object'").withColumn("owner", F.concat(F.lit("object:"), "owner"))
    return Schema(classes, of_class.unionByName(of_object).drop("kind"))


def known_path(schema: Schema, paths: DataFrame) -> DataFrame:
    """Adds ``type`` and ``is_array`` to (class_uid, path) rows; null where the class has no such path. ``evidences[0].name`` goes through an array."""
    part = F.regexp_replace(F.get("_parts", F.col("_n")), r"\[\d+\]$", "")
    rows = paths.withColumns({"_parts": F.split("path", r"\."), "_owner": F.concat(F.lit("class:"), F.col("class_uid").cast("string")), "_type": F.lit(None).cast("string"), "_array": F.lit(None).cast("boolean")})
    longest = rows.agg(F.coalesce(F.max(F.size("_parts")), F.lit(0))).first()[0]
    for n in range(longest):
        found = schema.attributes.select(F.col("owner").alias("_owner"), F.col("attribute").alias("_name"), F.col("type").alias("_t"), F.col("is_array").alias("_a"), F.col("object").alias("_o"))
        rows = rows.withColumn("_n", F.lit(n)).withColumn("_name", part).join(found, ["_owner", "_name"], "left")
        here, last = F.size("_parts") > n, F.size("_parts") == n + 1
        rows = rows.withColumns({"_type": F.when(last, F.col("_t")).otherwise(F.col("_type")), "_array": F.when(last, F.col("_a") & ~F.col("path").endswith("]")).otherwise(F.col("_array")), "_owner": F.when(here, F.concat(F.lit("object:"), "_o"))}).drop("_name", "_t", "_a", "_o", "_n")
    return rows.withColumnsRenamed({"_type": "type", "_array": "is_array"}).drop("_parts", "_owner")


def whole(value: Column) -> Column:
    """Whether a value is a whole number; true and false count as 1 and 0."""
    return F.schema_of_variant(value).rlike(r"^(BIGINT|BOOLEAN|DECIMAL\(\d+,0\))$")


def names_in(text: Column) -> Column:
    """How many names of members a JSON text has, at all levels."""
    bare = F.regexp_replace(text, r"\\.", "")
    return F.size(F.filter(F.regexp_extract_all(bare, F.lit(r'"[^"]*+"(\s*:)?'), F.lit(1)), lambda x: x != ""))


def faults(events: DataFrame, schema: Schema, key: str = "uid", event: str = "event", envelope: tuple[str, ...] = ENVELOPE) -> DataFrame:
    """What is wrong with events (``key`` and the event as JSON): key, kind, path, expected; nothing for a valid event.

    Kinds: ``missing`` (required, in the class and its objects to two levels), ``type`` (neither whole number nor boolean where one is due; null is
    neither), ``unknown`` (an attribute that its class or object doesn't have; a warning), ``class`` (no such class), ``json`` (not one JSON object: null, empty, broken, or with a
    name twice in an object). Events without a class or of class 0 aren't checked. Lists aren't entered. Rows that repeat a key each give their own faults.

    One row is one object of an event at a time: a level of the data is one lookup of the schema's owners, which is broadcast, and gives
    the faults of that object and the objects within it. Nothing is shuffled by event.
    """
    entry = F.struct("attribute", F.struct("type", "object", (F.col("requirement") == "required").alias("required")))
    owners = schema.attributes.groupBy("owner").agg(F.map_from_entries(F.collect_list(entry)).alias("attrs"))  # a class or object is one bounded row
    known = schema.classes.select(F.concat(F.lit("class:"), "class_uid").alias("owner")).join(owners, "owner", "left").unionByName(owners.filter("owner LIKE 'object:%'"))
    known = known.withColumn("known", F.lit(True))
    nothing = F.expr("cast(map() as map<string,struct<type:string,object:string,required:boolean>>)")  # a class or object without attributes takes all
    known = F.broadcast(known) if schema.attributes.count() <= MOST_BROADCAST else known
    members = "map<string,variant>"
    rows = events.select(F.col(key).alias("_key"), F.col(event).cast("string").alias("_text"))
    depth = rows.agg(F.coalesce(F.max(json_depth(F.col("_text"))), F.lit(0))).first()[0]
    rows = rows.withColumn("_json", F.try_parse_json("_text"))
    doubled = names_in(F.col("_text")) > names_in(F.to_json("_json"))  # extractors let the session's parser keep the last of repeated names
    rows = rows.select("_key", F.when(~doubled, F.try_variant_get("_json", "$", members)).alias("members"))
    uid = F.coalesce(F.expr("try_variant_get(try_element_at(members, 'class_uid'), '$', 'bigint')"), F.lit(0))
    none = F.expr("cast(array() as array<struct<kind:string,path:string,expected:string>>)")
    found = F.when(F.col("members").isNull(), F.array(F.struct(F.lit("json").alias("kind"), F.lit("").alias("path"), F.lit("object").alias("expected")))).otherwise(none)
    rows = rows.select("_key", F.lit("").alias("prefix"), F.when(F.col("members").isNotNull() & (uid != 0), F.concat(F.lit("class:"), uid.cast("string"))).alias("owner"), "members", found.alias("faults"))
    for level in range(max(1, depth)):
        have = lambda k: F.map_contains_key("members", k)
        fault = lambda kind, name, expected: F.struct(F.lit(kind).alias("kind"), F.concat("prefix", name).alias("path"), expected.alias("expected"))
        needed = F.map_keys(F.map_filter("attrs", lambda k, v: v["required"] & ~have(k))) if level <= REQUIRED_DEPTH else F.expr("cast(array() as array<string>)")
        inside = F.filter(F.map_entries("members"), lambda e: ~e["key"].isin(*envelope)) if level == 0 else F.map_entries("members")
        seen = F.transform(inside, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.try_element_at("attrs", e["key"]).alias("spec")))
        strange = F.filter("seen", lambda e: e["spec"].isNull() & (F.size("attrs") > 0))
        object_of = lambda e: F.when(e["spec"]["object"].isNotNull(), F.try_variant_get(e["value"], "$", members))
        wrong = F.filter("seen", lambda e: (e["spec"]["type"].isin(*WHOLE) & ~whole(e["value"])) | ((e["spec"]["type"] == "boolean_t") & (F.schema_of_variant(e["value"]) != "BOOLEAN")))
        within = F.filter("seen", lambda e: object_of(e).isNotNull())
        missing = F.transform(needed, lambda k: fault("missing", k, F.try_element_at("attrs", k)["type"]))
        unknown = F.transform(strange, lambda e: fault("unknown", e["name"], F.lit(None).cast("string")))
        typed = F.transform(wrong, lambda e: fault("type", e["name"], e["spec"]["type"]))
        here = F.when(F.col("owner").isNull(), F.col("faults")).when(~F.col("known"), F.array(F.struct(F.lit("class").alias("kind"), F.lit("class_uid").alias("path"), F.lit(None).cast("string").alias("expected")))).otherwise(F.concat(missing, typed, unknown))
        done = F.struct(F.lit("").alias("prefix"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast(members).alias("members"), here.alias("faults"))
        deeper = F.when(F.col("known"), F.transform(within, lambda e: F.struct(F.concat("prefix", e["name"], F.lit(".")).alias("prefix"), F.concat(F.lit("object:"), e["spec"]["object"]).alias("owner"), object_of(e).alias("members"), none.alias("faults"))))
        each = F.concat(F.filter(F.array(done), lambda x: F.size(x["faults"]) > 0), F.coalesce(deeper, F.filter(F.array(done), lambda _: F.lit(False))))
        rows = rows.join(known, "owner", "left").withColumns({"known": F.coalesce("known", F.col("owner").startswith("object:")), "attrs": F.coalesce("attrs", nothing)}).withColumn("seen", seen).select("_key", F.explode(each).alias("x")).select("_key", "x.*")
    return rows.select(F.col("_key").alias(key), F.explode("faults").alias("f")).select(key, "f.*")


def verdicts(events: DataFrame, schema: Schema, key: str = "uid", event: str = "event") -> DataFrame:
    """key, valid, errors and warnings (sorted) of each key; keys are taken to be unique. Only faulty events are shuffled before the join."""
    said = F.when(F.col("kind") == "missing", F.concat(F.lit("missing required "), "path")).when(F.col("kind") == "unknown", F.concat(F.lit("unknown attribute "), "path")).when(F.col("kind") == "type", F.concat(F.lit("type "), "path", F.lit(": expected "), "expected")).otherwise(F.concat(F.lit("unknown "), "kind"))
    wrong = faults(events, schema, key, event).withColumn("said", said)
    warns = F.col("kind") == "unknown"
    wrong = wrong.groupBy(key).agg(F.sort_array(F.collect_list(F.when(~warns, F.col("said")))).alias("errors"), F.sort_array(F.collect_list(F.when(warns, F.col("said")))).alias("warnings"))
    nothing = F.expr("cast(array() as array<string>)")
    out = events.select(key).join(wrong, key, "left").withColumns({"errors": F.coalesce("errors", nothing), "warnings": F.coalesce("warnings", nothing)})
    return out.select(key, (F.size("errors") == 0).alias("valid"), "errors", "warnings")
