"""Cards (JSON objects) as rows of findings; fragments from chat text; disclosures from landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import CARD_KIND, RuleSet
from ..operators.attribution import subject_entities
from ..functions.text import digits, normalize
from ..operators.classify import entity_type, mapped, plate, title_category

_STAMP = r"^\s*\[?(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)\]?\s*[\t,:：]?\s*(.*)$"


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per *.json file that holds an object; other files and broken ones are skipped. Ordered by file name where it matters."""
    raw = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), "value")
    return parsed(raw, "value")


def parsed(raw: DataFrame, column: str) -> DataFrame:
    """The cards in a column of JSON texts, with the other columns; what isn't an object goes.

    Models write cards, so values are taken as they come: an entity is a text or an object with a name, a number an object
    or a bare text or figure, and anything else among them is left out. Missing kinds are `concept`.
    """
    out = raw.withColumn("_v", F.try_parse_json(column)).filter(_is("_v", "OBJECT"))
    text = lambda v, path: f"try_variant_get({v}, '{path}', 'string')"
    listed = lambda v, path: f"coalesce(try_variant_get({v}, '{path}', 'array<variant>'), array())"
    named = lambda v: f"case when {_kind(v)} like 'OBJECT%' then coalesce({text(v, '$.name')}, '') else {text(v, '$')} end"
    figure = f"""transform(filter({listed("f", "$.numbers")}, n -> {_kind("n")} rlike '^(OBJECT|STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)'),
      n -> if({_kind("n")} like 'OBJECT%', named_struct('value', {text("n", "$.value")}, 'context', {text("n", "$.context")}, 'page', try_variant_get(n, '$.page', 'int'), '_v', {text("n", "$._v")}),
        named_struct('value', {text("n", "$")}, 'context', '', 'page', cast(null as int), '_v', cast(null as string))))"""
    own = f"""transform(filter({listed("f", "$.entities")}, e -> e is not null and {_kind("e")} not rlike '^(VOID|ARRAY)'), e -> {named("e")})"""
    entities = f"""transform(filter({listed("_v", "$.entities")}, e -> {_kind("e")} like 'OBJECT%' and coalesce({text("e", "$.name")}, '') <> ''),
      e -> named_struct('name', {text("e", "$.name")}, 'kind', coalesce(nullif({text("e", "$.kind")}, ''), 'concept'), 'code', {text("e", "$.code")}))"""
    found = f"""transform(filter({listed("_v", "$.findings")}, f -> {_kind("f")} like 'OBJECT%'), f -> named_struct('claim', {text("f", "$.claim")}, 'evidence', {text("f", "$.evidence")},
      'entities', {own}, 'numbers', {figure}, 'page', try_variant_get(f, '$.page', 'int'), 'confidence', {text("f", "$.confidence")}))"""
    factors = f"""transform(filter({listed("_v", "$.factors")}, f -> {_kind("f")} like 'OBJECT%'), f -> named_struct('name', {text("f", "$.name")}, 'intuition', {text("f", "$.intuition")}, 'formula', {text("f", "$.formula")},
      'performance', transform_values(try_variant_get(f, '$.performance', 'map<string,variant>'), (k, x) -> {text("x", "$")}), 'page', try_variant_get(f, '$.page', 'int')))"""
    fields = [F.expr(text("_v", f"$.{name}")).alias(name) for name in ("id", "type", "date", "broker", "title")]
    kept = [c for c in raw.columns if c != column]
    return out.select(*kept, *fields, F.expr(entities).alias("entities"), F.expr(found).alias("findings"), F.expr(factors).alias("factors"))


def _kind(v: str) -> str:
    return f"coalesce(schema_of_variant({v}), 'VOID')"


def _is(v: str, kind: str) -> Column:
    return F.expr(f"{_kind(v)} like '{kind}%'")


def code_map(cards: DataFrame, order: str = "id") -> DataFrame:
    """(doc_id, alias, code): the codes of a card's stocks by normalised name; of a name's codes the last in the card counts."""
    e = cards.select(F.col(order).alias("doc_id"), F.posexplode("entities").alias("pos", "e")).filter("e.kind = 'stock' and coalesce(e.code, '') <> ''")
    return e.groupBy("doc_id", normalize(F.col("e.name")).alias("alias")).agg(F.max_by("e.code", "pos").alias("code"))


def coded(entities: Column) -> Column:
    """The stocks with a code among a card's entities, in order: structs (alias, code) with the normalised name."""
    stocks = F.filter(entities, lambda e: (e["kind"] == "stock") & (F.coalesce(e["code"], F.lit("")) != ""))
    return F.transform(stocks, lambda e: F.struct(normalize(e["name"]).alias("alias"), e["code"].alias("code")))


def card_entities(cards: DataFrame, order: str = "id") -> DataFrame:
    """(doc_id, pos, name, kind, code): the entities of each card that have a name, with the registry's types."""
    e = cards.select(F.col(order).alias("doc_id"), F.posexplode("entities").alias("pos", "e"))
    return e.filter("trim(coalesce(e.name, '')) <> ''").select("doc_id", "pos", "e.name", entity_type(F.lower("e.kind")).alias("kind"), "e.code")


def findings(cards: DataFrame, order: str = "id", rules: RuleSet | None = None) -> DataFrame:
    """Findings, then factors, of each card in order: doc_id, pos, claim, evidence, numbers, own (entity names), page, source_kind, valid_at, broker.

    With rules the entities that can be a subject and the codes of stocks are worked out too, once a card (columns subjects, codes).
    """
    if rules is not None:
        cards = cards.withColumn("subjects", subject_entities(rules, F.col("entities"), F.col("broker"))).withColumn("codes", coded(F.col("entities")))
    more = [] if rules is None else ["subjects", "codes"]
    kind = F.coalesce(mapped(F.col("type"), CARD_KIND), F.lit("broker_research"))
    none = lambda c: F.coalesce(c, F.lit(""))
    number = "array<struct<value:string,context:string,page:int,_v:string>>"

    def from_finding(f: Column) -> Column:
        return F.struct(f["claim"].alias("claim"), none(f["evidence"]).alias("evidence"), F.coalesce(f["numbers"], F.array().cast(number)).alias("numbers"), F.coalesce(f["entities"], F.array().cast("array<string>")).alias("own"), f["page"].alias("page"))

    def from_factor(f: Column) -> Column:
        entries = F.coalesce(F.map_entries(f["performance"]), F.array().cast("array<struct<key:string,value:string>>"))
        told = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), none(e["value"]))), "; ")
        numbers = F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["key"].alias("context"), f["page"].alias("page"), F.lit(None).cast("string").alias("_v")))
        claim = F.substring(F.concat(F.lit("因子「"), f["name"], F.lit("」"), none(f["intuition"])), 1, 120)
        return F.struct(claim.alias("claim"), F.when(told != "", told).otherwise(F.substring(none(f["formula"]), 1, 200)).alias("evidence"), numbers.cast(number).alias("numbers"), F.array(f["name"]).alias("own"), f["page"].alias("page"))

    listed = F.coalesce(F.transform(F.filter("findings", lambda f: none(f["claim"]) != ""), from_finding), F.array())
    factors = F.coalesce(F.transform(F.filter("factors", lambda f: none(f["name"]) != ""), from_factor), F.array())
    return cards.select(F.col(order).alias("doc_id"), F.col("type").alias("card_type"), "title", none(F.col("broker")).alias("broker"), none(F.col("date")).alias("valid_at"), kind.alias("source_kind"), "entities", *more, F.posexplode(F.concat(listed, factors)).alias("pos", "f")).select("doc_id", "pos", "card_type", "title", "broker", "valid_at", "source_kind", "entities", *more, "f.*")


def fragments(lines: DataFrame, column: str = "value") -> DataFrame:
    """(text, timestamp) of non-blank lines; a leading date, with or without time and brackets, is the timestamp if a text follows."""
    own = lines.select(F.trim(F.col(column)).alias("line")).filter(F.length("line") > 0)
    stamp, rest = F.regexp_extract("line", _STAMP, 1), F.trim(F.regexp_extract("line", _STAMP, 2))
    stamped = (stamp != "") & (rest != "")
    return own.select(F.when(stamped, rest).otherwise(F.col("line")).alias("text"), F.when(stamped, stamp).otherwise("").alias("timestamp"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(text, timestamp) of the lines of chat or comment files."""
    return fragments(spark.read.text(path))


def disclosures(primary: DataFrame, fallback: DataFrame, per_code: int, categories: tuple[str, ...] | None = None, rules: RuleSet | None = None) -> DataFrame:
    """Announcements (code, title, date, url) of the primary source, or of the fallback for codes it has none for; the newest per code.

    With rules they get the category of their title, and with categories others than these are left out before the newest are taken.
    """
    from pyspark.sql import Window

    missing = fallback.join(primary, "code", "left_anti").withColumn("source", F.lit("fallback"))
    both = primary.withColumn("source", F.lit("primary")).unionByName(missing)
    if rules is not None:
        both = both.withColumn("category", title_category(rules, F.col("title")))
        both = both if categories is None else both.filter(F.col("category").isin(*categories))
    newest = Window.partitionBy("code").orderBy(F.desc("date"), "title", "url")
    return both.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_code).drop("_n")


def landed_disclosures(raw: DataFrame) -> DataFrame:
    """Announcements as the fallback source lands them: the title under either of two names, the date cut to the day."""
    return raw.select(F.col("SECCODE").alias("code"), F.coalesce("TITLE", "BULLETIN_TITLE").alias("title"), F.substring("SSEDATE", 1, 10).alias("date"), F.col("URL").alias("url"))


def organisations(codes: DataFrame, stocks: DataFrame) -> DataFrame:
    """codes (code and more) with org_id and plate: a listed stock's own (stocks: code, org_id, plate), else no id and the plate of its code."""
    known = stocks.select(digits(F.col("code")).alias("_code"), "org_id", F.col("plate").alias("_plate")).dropDuplicates(["_code"])
    out = codes.join(known, digits(codes["code"]) == known["_code"], "left")
    return out.withColumn("plate", F.coalesce(F.expr("nullif(_plate, '')"), plate(F.col("code")))).drop("_code", "_plate")


def has_announcement(codes: DataFrame, announcements: DataFrame, keyword: str = "", category: str | None = None) -> DataFrame:
    """Codes with an announcement whose title contains the keyword and, if asked for, that is of a category."""
    fit = announcements.filter(F.col("title").contains(keyword))
    fit = fit if category is None else fit.filter(F.col("category") == category)
    return codes.join(fit, "code", "left_semi")
