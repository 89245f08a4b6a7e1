"""Pages told by their addresses: a table of path rules as a trie of prefixes, met by an equi-join, so thousands of rules cost what ten do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.urls import resource_type

#: A rule's segment that stands for any one segment, and for a year.
ANY, YEAR = "*", "<year>"
RULES = "prefix string, least int, section string, kind string, deeper_kind string, owner_at int"


def segments(url: Column) -> Column:
    """Decoded parts of a path, without empty ones; none for an address that has no path or can't be read."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    decoded = F.transform(F.split(path, "/"), lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))
    return F.filter(decoded, lambda s: s != "")


def prefixes(parts: Column) -> Column:
    """The keys under which rules may stand for a path: for each length, the path itself and the path with its last part as any or as a
    year, each with how deep it is and how plain (0: as it stands, 1: year, 2: any)."""
    none = F.array(F.struct(F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.lit(0).alias("vague")))

    def keys(n: Column) -> Column:
        head, last = F.array_join(F.slice(parts, 1, n - 1), "/"), F.element_at(parts, n)
        key = lambda s: F.when(n == 1, s).otherwise(F.concat(head, F.lit("/"), s))
        forms = [(key(last), 0, F.lit(True)), (key(F.lit(YEAR)), 1, last.rlike("^(19|20)[0-9]{2}$")), (key(F.lit(ANY)), 2, F.lit(True))]
        return F.array_compact(F.array(*[F.when(test, F.struct(k.alias("prefix"), n.alias("depth"), F.lit(v).alias("vague"))) for k, v, test in forms]))

    deeper = F.when(F.size(parts) == 0, F.array().cast("array<struct<prefix:string,depth:int,vague:int>>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), keys)))
    return F.concat(none, deeper)


def classify(pages: DataFrame, rules: DataFrame, owners: DataFrame, *, key: str, url: str) -> DataFrame:
    """(key, section, kind, owner, resource_type, evidence) of each page.

    `rules` are rows of RULES: a prefix of segments (joined by `/`, the empty one for the root; the last segment may be `*` or `<year>`), how many segments
    an address needs at least, the section, the kind of the page at the prefix itself and of pages below it (null: the same), and at which segment
    (from 1) an owner's code stands, if it does; such a rule applies only if that code is among `owners` (code). Of the rules that apply the longest
    prefix wins, then the plainer one, then the prefix by name. A page that no rule takes is `page` in section `other`. Keys are unique.

    An address is exploded into its prefixes and joined to the rules on them; neither table is collected, and Spark broadcasts the rules only if they are small.
    """
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), segments(F.col(url)).alias("parts"))
    asked = own.select("key", "parts", F.explode(prefixes(F.col("parts"))).alias("p")).select("key", "parts", "p.*")
    met = asked.join(rules.select(*[c.split()[0] for c in RULES.split(", ")]), "prefix").where(F.size("parts") >= F.col("least")).withColumn("code", F.when(F.col("owner_at").isNotNull(), F.coalesce(F.get("parts", F.col("owner_at") - 1), F.lit(""))))
    held = met.join(owners.select(F.col("code").alias("known")).distinct(), F.col("code") == F.col("known"), "left").where("code is null or known is not null")
    kind = F.when((F.size("parts") > F.col("depth")) & F.col("deeper_kind").isNotNull(), F.col("deeper_kind")).otherwise(F.col("kind"))
    best = held.groupBy("key").agg(F.min(F.struct((-F.col("depth")).alias("longest"), "vague", "prefix", "section", kind.alias("kind"), "known")).alias("r"))
    none = F.concat(F.lit("no rule for "), F.coalesce(F.get("parts", F.lit(0)), F.lit("the root")))
    return own.join(best, "key", "left").select(
        F.col("key").alias(key), F.when(F.col("r").isNull(), "other").otherwise(F.col("r.section")).alias("section"), F.coalesce("r.kind", F.lit("page")).alias("kind"), F.col("r.known").alias("owner"),
        resource_type(F.col("url"), F.lit(None).cast("string")).alias("resource_type"), F.when(F.col("r").isNull(), none).otherwise(F.concat(F.lit("prefix "), F.col("r.prefix"))).alias("evidence"),
    )
