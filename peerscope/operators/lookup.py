"""Batch fuzzy lookup of many queries in a dictionary of schools, cities and boards.

Candidates come from three equi-joins that together miss nothing: words that start with a query
word, words similar to one (rarest-bigram prefixes), and documents that contain the query's rarest
bigram. Only candidates are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.text import let, normalize_query
from peerscope.operators.ranking import running_sum
from peerscope.session import materialize, spread

FUZZY_THRESHOLD = 0.6
PER_KIND = 6
#: Words of a sorted dictionary that are joined together.
PAGE = 64


def _document(kind: str, label: Column, sublabel: Column, href: Column) -> list[Column]:
    folded = normalize_query(label)
    return [
        F.lit(kind).alias("kind"),
        label.alias("label"),
        sublabel.alias("sublabel"),
        href.alias("href"),
        folded.alias("folded"),
        F.filter(F.split(folded, " "), lambda w: w != "").alias("words"),
    ]


def search_documents(schools: DataFrame, boards: DataFrame) -> DataFrame:
    """One document per school (name, slug, city, board_name), distinct city and board (name, slug)."""
    place = F.array_join(F.filter(F.array("city", "board_name"), lambda p: F.coalesce(p, F.lit("")) != ""), " · ")
    by_school = schools.select(*_document("school", F.col("name"), place, F.concat(F.lit("/schools/"), "slug")))
    cities = (
        schools.filter(F.coalesce("city", F.lit("")) != "")
        .groupBy(normalize_query(F.col("city")).alias("_key"))
        .agg(F.min_by("city", F.struct("name", "slug")).alias("city"), F.count("*").alias("n"))
    )
    number = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " school").otherwise(" schools"))
    encoded = F.replace(F.url_encode("city"), F.lit("+"), F.lit("%20"))
    by_city = cities.select(*_document("city", F.col("city"), number, F.concat(F.lit("/schools?city="), encoded)))
    by_board = boards.select(*_document("board", F.col("name"), F.lit(None).cast("string"), F.concat(F.lit("/boards/"), "slug")))
    return by_school.unionByName(by_city).unionByName(by_board)


def bigrams(word: Column) -> Column:
    """Distinct adjacent character pairs of the word padded with one space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2))))


def _text_bigrams(text: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
    )


def dice(left: Column, right: Column) -> Column:
    """Sorensen-Dice coefficient of two bigram sets."""
    return F.size(F.array_intersect(left, right)) * 2.0 / (F.size(left) + F.size(right))


def with_bigrams(words: Column) -> Column:
    """ARRAY<STRUCT<w, g>>: words with their bigram sets, computed once per text."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), bigrams(w).alias("g")))


def score_document(query: Column, asked: Column, folded: Column, words: Column) -> Column:
    """100 prefix, 80 every query word starts a word, 60 substring, 40 x mean similarity from 0.6 on.

    ``asked`` and ``words`` are the words of query and document ``with_bigrams``.
    """

    def best(q: Column) -> Column:
        near = F.transform(words, lambda w: F.when(w["w"].startswith(q["w"]), F.lit(1.0)).otherwise(dice(q["g"], w["g"])))
        return F.coalesce(F.array_max(near), F.lit(0.0))

    starts = F.forall(asked, lambda q: F.exists(words, lambda w: w["w"].startswith(q["w"])))
    mean = F.aggregate(asked, F.lit(0.0), lambda a, q: a + best(q)) / F.size(asked)
    fuzzy = let(mean, lambda m: F.when(m >= FUZZY_THRESHOLD, m * 40).otherwise(0.0))
    return (
        F.when(query == "", F.lit(0.0))
        .when(folded.startswith(query), F.lit(100.0))
        .when(starts, F.lit(80.0))
        .when(F.contains(folded, query), F.lit(60.0))
        .otherwise(fuzzy)
    )


def starting_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, word) of distinct known words that start with a distinct asked one.

    In a sorted dictionary those are a range, from the asked word up to its last possible continuation. Both ends are laid among the
    words by one running sum, and ranges meet words by pages of ``PAGE`` words, so there is a row per word and per page of a range.
    """
    rows = known.select(F.col("word").alias("text"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("one"))
    ends = F.explode(F.array(F.struct(F.col("asked").alias("text"), F.lit(0).alias("kind")), F.struct(F.concat("asked", F.lit("\U0010ffff")).alias("text"), F.lit(2).alias("kind"))))
    asked_ends = asked.select("asked", ends.alias("end")).select("asked", "end.*")
    laid = rows.withColumn("asked", F.lit(None).cast("string")).unionByName(asked_ends.withColumn("one", F.lit(0).cast("long")))
    placed = running_sum(laid, [], ["text", "kind"], "one", "place")
    placed = materialize(placed.select("text", "asked", "kind", "place"))
    words = placed.filter("kind = 1").select(F.col("text").alias("word"), (F.col("place") - 1).alias("place")).withColumn("page", F.floor(F.col("place") / PAGE))
    at = [F.max(F.when(F.col("kind") == kind, F.col("place"))).alias(name) for kind, name in ((0, "first"), (2, "past"))]
    ranges = placed.filter("kind <> 1").groupBy("asked").agg(*at).filter("first < past")
    paged = ranges.withColumn("page", F.explode(F.sequence(F.floor(F.col("first") / PAGE), F.floor((F.col("past") - 1) / PAGE))))
    return paged.join(words, "page").filter("place >= first and place < past").select("asked", "word")


def similar_words(asked: DataFrame, known: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(asked, word) couples that may reach the threshold, plus words that start with the asked one.

    Sets with Dice >= t share at least t/(2-t) of either set, so both have one of the rarest
    |set| - need + 1 bigrams in common.
    """
    starting = starting_words(asked.select("asked"), known.select("word"))
    grams = known.select("word", F.explode(bigrams(F.col("word"))).alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("_f"))  # bounded by the alphabet squared

    def rarest(df: DataFrame, name: str) -> DataFrame:
        size = F.size(bigrams(F.col(name)))
        order = Window.partitionBy(name).orderBy(F.coalesce("_f", F.lit(0)), "gram")
        need = F.ceil(size * (threshold / (2 - threshold)) - 1e-9)
        return (
            df.select(name, (size - need + 1).alias("_keep"), F.explode(bigrams(F.col(name))).alias("gram"))
            .join(frequency, "gram", "left")
            .withColumn("_n", F.row_number().over(order))
            .filter("_n <= _keep")
            .select(name, "gram")
        )

    met = rarest(asked.select("asked"), "asked").join(rarest(known, "word"), "gram").select("asked", "word").distinct()
    close = met.filter(dice(bigrams(F.col("asked")), bigrams(F.col("word"))) >= threshold)
    return close.union(starting).distinct()


def lookup_scores(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, document columns, score) for every document with a positive score."""
    asked = queries.select(normalize_query(F.col("text")).alias("query")).distinct().filter(F.length("query") >= 2)
    asked = materialize(asked.withColumn("asked", with_bigrams(F.split("query", " "))))
    # equal texts are scored once; the grams are read by three joins
    texts = materialize(documents.groupBy("folded").agg(with_bigrams(F.first("words")).alias("words")))
    query_words = asked.select("query", F.explode("asked.w").alias("asked"))
    text_words = texts.select("folded", F.explode("words.w").alias("word")).distinct()
    couples = similar_words(query_words.select("asked").distinct(), text_words.select("word").distinct())
    by_word = query_words.join(couples, "asked").select("query", "word").distinct().join(text_words, "word").select("query", "folded")

    postings = texts.select("folded", F.explode(_text_bigrams(F.col("folded"))).alias("gram"))
    frequency = postings.groupBy("gram").agg(F.count("*").alias("_f"))
    rarest = (
        asked.select("query", F.explode(_text_bigrams(F.col("query"))).alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy("query")
        .agg(F.min_by("gram", F.struct(F.coalesce("_f", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    by_text = rarest.join(postings, "gram").filter(F.contains("folded", F.col("query"))).select("query", "folded")
    candidates = spread(by_word.union(by_text), "query", "folded").distinct()
    scored = (
        candidates.join(texts, "folded")
        .join(asked, "query")
        .withColumn("score", score_document(F.col("query"), F.col("asked"), F.col("folded"), F.col("words")))
        .filter("score > 0")
        .select("query", "folded", "score")
    )
    return scored.join(documents, "folded")


def lookup(queries: DataFrame, documents: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """The best ``per_kind`` documents per query and kind: score, then label, then link.

    Documents with the same text have the same score, so only the first ``per_kind`` of each kind meet the queries.
    """
    same = Window.partitionBy("folded", "kind").orderBy("label", "href")
    first = documents.withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") <= per_kind).drop("_nth")
    order = Window.partitionBy("query", "kind").orderBy(F.desc("score"), "folded", "label", "href")
    return (
        lookup_scores(queries, materialize(first))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= per_kind)
        .select("query", "kind", "position", "label", "sublabel", "href", "score")
    )
