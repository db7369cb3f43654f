"""Freely typed values mapped to the entries of reference lists, in SQL expressions only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.session import broadcast_if_small, checkpointed

#: Fixed: letters that look like Latin ones, and Latin letters that no decomposition leads to a plain one.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t"}
#: Fixed: marks that are not seen.
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Fixed: words that add a detail to a host, or to a place, without changing what it is.
HOST_DETAILS = ("host", "species", "sp", "spp", "adult", "juvenile", "young", "old", "dead", "live", "domestic", "dairy", "farmed", "captive", "female", "male", "herd", "flock", "feedlot", "blood", "serum", "nasal", "swab", "y", "yr", "years", "months", "weeks", "l", "linnaeus")
PLACE_DETAILS = ("nr", "near", "prov", "province", "district", "region", "town", "village", "farm", "county", "of", "the", "rural", "urban", "unspecified", "unknown", "country", "northern", "southern", "eastern", "western", "central")
#: Fixed: words for no value at all, whatever they resemble.
NOTHING = ("various", "mixed", "unknown", "missing", "other", "others", "none", "test", "undetermined", "unspecified", "several", "imported")
BREAKS = r"[,;/|()\[\]:]|\s-\s"


def _fold_table() -> tuple[str, str]:
    """Characters and the plain lower-case letters that stand for them, by decomposition; unseen ones go."""
    table = dict(LOOKALIKES)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(code).lower())
        plain = "".join(c for c in plain if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            table[chr(code)] = plain
    table |= {k.upper(): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1}
    table |= {"\u00a0": " ", "_": " "}
    gone = UNSEEN + "".join(map(chr, range(0x300, 0x370)))
    return "".join(table) + gone, "".join(table.values())


def folded(value: Column) -> Column:
    """Lower case, without accents, look-alikes, full-width letters and unseen marks."""
    return F.translate(F.lower(F.translate(value, *_fold_table())), *_fold_table())


def words(text: Column, details: tuple[str, ...]) -> Column:
    """The words of a folded text without details and numbers; digits that a reader takes for a letter count as that letter."""
    split = F.split(F.btrim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")
    kept = F.filter(split, lambda w: (w != "") & ~w.isin(*details) & ~w.rlike("^[0-9]+$"))
    return F.transform(kept, lambda w: F.translate(w, "056", "osb"))


def spaced(text: Column, details: tuple[str, ...]) -> Column:
    return F.array_join(words(text, details), " ")


def compact(spaced_text: Column) -> Column:
    return F.replace(spaced_text, F.lit(" "), F.lit(""))


def host_forms(hosts: DataFrame) -> DataFrame:
    """(kind, entry, region, way, text): every way to write a host: names, plurals, other order, short genus; text is without spaces."""
    names = hosts.select("host_id", F.explode(F.filter(F.concat(F.array("host_name", "scientific_name"), F.coalesce(F.split("other_names", ";"), F.array())), lambda x: x.isNotNull() & (F.btrim(x) != ""))).alias("name"), F.lower("scientific_name").alias("sci"))
    fold = folded(F.col("name"))
    parts = F.split(fold, " ")
    two = F.size(parts) == 2
    ways = F.array(fold, F.concat(fold, F.lit("s")), F.when(two, F.concat(parts[1], F.lit(" "), parts[0])), F.when(two & (F.lower("name") == F.col("sci")), F.concat(F.substring(fold, 1, 1), F.lit(" "), parts[1])))
    return names.select(F.lit("host").alias("kind"), F.col("host_id").cast("bigint").alias("entry"), F.lit("").alias("region"), F.explode(F.array_compact(ways)).alias("way")).select("kind", "entry", "region", spaced(F.col("way"), HOST_DETAILS).alias("way")).withColumn("text", compact(F.col("way"))).where("text <> ''").distinct()


def place_forms(places: DataFrame) -> DataFrame:
    """(kind, entry, region, way, text): countries by name, code and other names, districts by name; region is the country's name."""
    country = places.where(F.col("district").isNull()).select(
        F.lit("country").alias("kind"), F.col("location_id").cast("bigint").alias("entry"), F.col("country").alias("region"),
        F.explode(F.concat(F.array("country", "country_code"), F.coalesce(F.split("other_names", ";"), F.array()))).alias("way"),
    )
    district = places.where(F.col("district").isNotNull()).select(F.lit("district").alias("kind"), F.col("location_id").cast("bigint").alias("entry"), F.col("country").alias("region"), F.col("district").alias("way"))
    return country.unionByName(district).select("kind", "entry", "region", spaced(folded(F.col("way")), PLACE_DETAILS).alias("way")).withColumn("text", compact(F.col("way"))).where("text <> ''").distinct()


def edits(n: Column) -> Column:
    """Edits within which a text may be a form of n letters.  Short forms get two for the sake of swapped letters only."""
    return F.when(n <= 3, 0).when(n <= 12, 2).otherwise(3)


def similar(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(field, text, kind, entry, region, way, cost) of each text and form of one field that are equal or within ``edits`` of each other.

    Equal ones are joined as they are.  A form is cut into one more segment than it may have edits, so
    a text in reach holds one of them unchanged, shifted by no more than the edits.  Texts without an
    equal form are joined with the segments on length, place and substring, and what meets is
    verified by the edit distance.  A text with "rn" is also tried with "m", which a reader takes it for, at a cost of 2.  Cost is 4 for an edit, 1 more if the first letters differ, 2 less if
    both have the same letters; 0 for equal ones.  Texts and result are written, as each is read several times.
    """
    key = ["field", "text"]
    tried = checkpointed(texts.select("field", F.col("text").alias("asked"), F.explode(F.array_distinct(F.array("text", F.replace("text", F.lit("rn"), F.lit("m"))))).alias("text")))
    texts = tried.select(*key).distinct()
    equal = texts.join(forms, key).select(*key, "kind", "entry", "region", "way", F.lit(0).alias("cost"))
    others = texts.join(forms.select(*key).distinct(), key, "left_anti").where(F.length("text") >= 3).withColumn("m", F.length("text"))
    # Each text becomes some hundred substrings, so a few megabytes of texts are work for all cores.
    others = others.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism, *key)

    sized = forms.withColumn("n", F.length("text")).withColumn("k", edits(F.length("text"))).where("k > 0")
    cut = sized.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
    cut = cut.withColumn("start", F.floor(F.col("j") * F.col("n") / (F.col("k") + 1)).cast("int")).withColumn("size", F.floor((F.col("j") + 1) * F.col("n") / (F.col("k") + 1)).cast("int") - F.col("start"))
    segments = cut.select("field", F.col("text").alias("form"), "kind", "entry", "region", "way", "n", "k", "start", F.substring(F.col("text"), F.col("start") + 1, F.col("size")).alias("part"))
    layout = cut.select("field", "n", "k", "start", "size").distinct()
    layout = layout.withColumn("m", F.explode(F.sequence(F.greatest(F.col("n") - F.col("k"), F.lit(1)), F.col("n") + F.col("k"))))
    layout = layout.withColumn("place", F.explode(F.sequence(F.greatest(F.col("start") - F.col("k"), F.lit(0)), F.col("start") + F.col("k")))).where("place + size <= m").select("field", "m", "n", "start", "size", "place").distinct()

    parts = others.join(broadcast_if_small(layout), ["field", "m"]).select(*key, "n", "start", F.substring(F.col("text"), F.col("place") + 1, F.col("size")).alias("part"))
    met = parts.join(broadcast_if_small(segments), ["field", "n", "start", "part"]).select(*key, "form", "kind", "entry", "region", "way", "n", "k").distinct()
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    met = met.withColumn("distance", F.expr("levenshtein(text, form, 3)")).where(F.col("distance").between(1, F.col("k")))
    same = letters(F.col("text")) == letters(F.col("form"))
    near = met.where((F.col("n") >= 8) | (F.col("distance") <= 1) | same)
    cost = F.col("distance") * 4 + F.when(F.substring("text", 1, 1) == F.substring("form", 1, 1), 0).otherwise(1) - F.when(same, 2).otherwise(0)
    hits = equal.unionByName(near.where(~F.col("text").isin(*NOTHING)).select(*key, "kind", "entry", "region", "way", cost.alias("cost")))
    own = tried.join(hits, key).withColumn("cost", F.col("cost") + F.when(F.col("asked") == F.col("text"), 0).otherwise(2))
    return checkpointed(own.groupBy("field", F.col("asked").alias("text"), "kind", "entry", "region", "way").agg(F.min("cost").alias("cost")))


def open_values(rows: DataFrame, field: str, names: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, value) of the rows whose value is neither null, white space only, nor identical to a name."""
    own = rows.select(key, F.col(field).alias("value")).where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)[^\s]"))
    return own.join(names.select(names.columns[0]).distinct().withColumnRenamed(names.columns[0], "value"), "value", "left_anti")


def host_pieces(values: DataFrame) -> DataFrame:
    """(value, at, text, written, other) of the whole value (at 0) and of its parts between breaks."""
    text = folded(F.col("value"))
    pieces = F.filter(F.transform(F.split(text, BREAKS), lambda p: spaced(p, HOST_DETAILS)), lambda p: p != "")
    cut = values.select("value", spaced(text, HOST_DETAILS).alias("whole"), pieces.alias("pieces"))
    asked = cut.select("value", F.posexplode(F.concat(F.array("whole"), F.when(F.size("pieces") > 1, F.col("pieces")).otherwise(F.array()))).alias("at", "written"))
    return asked.select("value", "at", compact(F.col("written")).alias("text"), "written", F.lit("").alias("other")).where("text <> ''")


def match_hosts(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(value, entry) of the values that mean a host.

    A value means a host if all of it is one of the host's forms, or if its first part is and the others
    either are forms of the same host or none.
    """
    # Of forms as close without spaces, the one that is closest as it is written.
    best = Window.partitionBy("value", "at").orderBy("cost", F.levenshtein("written", "way"), "entry")
    per = asked.join(found, "text").withColumn("rank", F.row_number().over(best)).where("rank = 1").groupBy("value").agg(
        F.min(F.struct("at", "entry")).alias("first"), F.countDistinct(F.when(F.col("at") > 0, F.col("entry"))).alias("kinds"), F.min(F.when(F.col("at") == 0, F.col("entry"))).alias("whole"))
    return per.select("value", F.when(F.col("whole").isNotNull(), F.col("whole")).when((F.col("first.at") == 1) & (F.col("kinds") == 1), F.col("first.entry")).alias("entry")).where("entry is not null")


#: Stands for the rest of a value where it is longer than any form could be.
REST = "\u0001"


def place_sides(values: DataFrame, longest: int) -> DataFrame:
    """(value, at, text, written, other): the words of a value as a whole and cut in two, either side first.

    Only sides of at most ``longest`` words can be a form, as each word has a letter; the other side of such a cut stays as
    ``REST``.  So a value has at most twice as many cuts, however long it is, and none that could match is left out.
    """
    cut = values.select("value", words(folded(F.col("value")), PLACE_DETAILS).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    side = lambda first, size: F.when(size <= longest, F.array_join(F.slice("w", first, size), "")).otherwise(F.lit(REST))
    ends = F.array_union(F.sequence(F.lit(1), F.least(F.col("n") - 1, F.lit(longest))), F.sequence(F.greatest(F.col("n") - longest, F.lit(1)), F.col("n") - 1))
    halves = F.transform(ends, lambda i: F.struct(side(F.lit(1), i).alias("text"), side(i + 1, F.col("n") - i).alias("other")))
    whole = F.array(F.struct(side(F.lit(1), F.col("n")).alias("text"), F.lit("").alias("other")))
    turned = F.transform(halves, lambda x: F.struct(x["other"].alias("text"), x["text"].alias("other")))
    sides = F.concat(whole, F.when(F.col("n") > 1, F.concat(halves, turned)).otherwise(F.slice(whole, F.lit(1), F.lit(0))))
    return cut.select("value", F.explode(sides).alias("x")).select("value", F.lit(0).alias("at"), "x.text", F.lit("").alias("written"), "x.other").where(F.col("text") != REST)


def match_places(sides: DataFrame, found: DataFrame) -> DataFrame:
    """(value, entry) of the values that mean a place.

    A country beside one of its districts, in either
    order, means the district; a district alone means it if only one country has it; a country
    alone or beside other words means the country.  A district beside other words means nothing listed.
    The cheapest reading counts, and equal ones of different entries cancel out.
    """
    country = found.where("kind = 'country'").groupBy("text", "entry", "region").agg(F.min("cost").alias("cost")).select("text", F.col("entry").alias("c_entry"), "region", F.col("cost").alias("c_cost"))
    district = found.where("kind = 'district'").groupBy("text", "entry", "region").agg(F.min("cost").alias("cost")).select("text", F.col("entry").alias("d_entry"), "region", F.col("cost").alias("d_cost"))
    by_country = sides.join(country, "text")
    # A country beside its district, else the country for what it costs, dearer beside other words.
    beside = by_country.where("other <> ''").join(district.withColumnRenamed("text", "other"), ["other", "region"]).select("value", F.col("d_entry").alias("entry"), (F.col("c_cost") + F.col("d_cost")).alias("cost"))
    alone = by_country.select("value", F.col("c_entry").alias("entry"), (F.col("c_cost") + F.when(F.col("other") == "", 0).otherwise(100)).alias("cost"))
    single = sides.where("other = ''").join(district, "text").select("value", F.col("d_entry").alias("entry"), F.col("d_cost").alias("cost"))
    readings = beside.unionByName(alone).unionByName(single).groupBy("value", "entry").agg(F.min("cost").alias("cost"))
    # Of each value the entries at its least cost: one, or more that cancel out.
    least = readings.groupBy("value", "cost").agg(F.min("entry").alias("entry"), F.count("*").alias("n")).groupBy("value").agg(F.min(F.struct("cost", "entry", "n")).alias("x"))
    return least.where("x.n = 1").select("value", "x.entry")


def map_values(rows: DataFrame, hosts: DataFrame, places: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, value, ref_id) of every row and field with a value to be mapped; ref_id is -1 if it means nothing listed.

    Null values, white space and values identical to a host_name or location_name are no cases.  Empty reference lists map
    all values to -1.  Values are mapped once each, however many rows have them and however long they are; rows given twice come out twice.
    Both fields go through one search.  Other columns are not read.
    """
    parts = [open_values(rows, field, names, key).select(key, F.lit(field).alias("field"), "value") for field, names in (("host", hosts.select("host_name")), ("location", places.select("location_name")))]
    own = parts[0].unionByName(parts[1])
    values = checkpointed(own.select("field", "value").distinct())
    of = lambda df, field: df.where(F.col("field") == field).drop("field")
    forms = checkpointed(host_forms(hosts).withColumn("field", F.lit("host")).unionByName(place_forms(places).withColumn("field", F.lit("location"))))
    longest = (forms.agg(F.max(F.length("text"))).first()[0] or 0) + 3
    asked = checkpointed(host_pieces(of(values, "host")).withColumn("field", F.lit("host")).unionByName(place_sides(of(values, "location"), longest).withColumn("field", F.lit("location"))))
    found = similar(asked.select("field", "text").where(F.length("text") <= longest).distinct(), forms)
    meant = match_hosts(of(asked, "host"), of(found, "host")).withColumn("field", F.lit("host")).unionByName(match_places(of(asked, "location"), of(found, "location")).withColumn("field", F.lit("location")))
    meant = checkpointed(meant)
    unmatched = values.join(meant, ["field", "value"], "left_anti").select("field", "value", F.lit(-1).cast("bigint").alias("entry"))
    return own.join(meant.select("field", "value", "entry").unionByName(unmatched), ["field", "value"]).select(key, "field", "value", F.col("entry").alias("ref_id"))


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """Values that mean nothing listed, with their rows."""
    return mapped.where("ref_id = -1").groupBy("field", "value").agg(F.count("*").alias("n_rows"))

