"""Corpus, retrieval, graph and model queries. Operator ids of the survey in brackets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.aggregates import share
from millrace.operators import retrieval as R
from millrace.operators.induction import induce_types
from millrace.operators.merges import merge_vocabulary
from millrace.operators.nearest import most_similar
from millrace.session import cut
from millrace.tables import load

QUERY = "compiler branch error"
BINS = 1001
#: Up to so many rows of three numbers a table is sent to all executors.
LISTED_ROWS = 200_000
#: Up to so many terms of two documents or more are sent to all executors.
LISTED_TERMS = 1_000_000


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").filter("text IS NOT NULL")


def _word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.term_counts(_docs(spark, folder).select("doc_id", X.words(F.col("text")).alias("w")), "doc_id", "w")


def dedupe_by_content(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct text: the smallest id and the number of copies [A24]."""
    return _docs(spark, folder).groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How often each token occurs, and in how many documents [A25]."""
    return _word_counts(spark, folder).groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


def top_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most frequent tokens of each language without stop words, a top-k report [T5 T22 O1 O2]."""
    d = _docs(spark, folder).select(F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("")).alias("lang"), F.explode(X.without(X.words(F.col("text")), X.STOP_WORDS)).alias("term"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return d.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(w)).filter("place <= 20")


def split_name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of camel and snake case names, in any script [T4]."""
    return _docs(spark, folder).select(F.explode(X.split_names(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of all runs of three tokens [T1]."""
    return _docs(spark, folder).select(F.explode(X.ngrams(X.words(F.col("text")), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def stem_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of Porter stems of the distinct words; other than plain letters they stay as they are [T6]."""
    words = _word_counts(spark, folder).groupBy("term").agg(F.sum("c").alias("n"))
    return words.select(X.stems(F.array("term"))[0].alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


def normalised_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Characters, bytes and the number of brackets and back ticks [T27]."""
    return _docs(spark, folder).select("doc_id", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), (F.length("text") - F.length(F.regexp_replace("text", r"[`\[\]]", ""))).alias("quotes"))


def page_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, markup taken away [T7]."""
    return _docs(spark, folder).select(F.explode(X.html_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def idf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse document frequency, logarithm of 10 [T10]."""
    n = load(spark, folder, "documents").filter("text IS NOT NULL").count()
    return R.idf(_word_counts(spark, folder), "doc_id", n).select("term", "df", F.round("idf", 6).alias("idf"))


def tf_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Both term frequencies of each document's terms [T11]."""
    return R.tf(_word_counts(spark, folder), "doc_id").select("doc_id", "term", F.round("tf", 6).alias("tf"), F.round("tf_short", 6).alias("tf_short"))


def query_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each document with a fixed query in tf-idf space, with normalised scores [T12 T13 M13]."""
    n = load(spark, folder, "documents").filter("text IS NOT NULL").count()
    counts = _word_counts(spark, folder)
    weighted = R.tf(counts, "doc_id").join(R.idf(counts, "doc_id", n), "term").withColumn("w", F.col("tf") * F.col("idf"))
    vectors = R.unit_vectors(weighted, "doc_id", "w")
    terms = QUERY.split()
    hits = vectors.filter(F.col("term").isin(terms))
    length = R.idf(counts, "doc_id", n).filter(F.col("term").isin(terms)).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))))
    scored = hits.withColumn("nq", length.scalar()).groupBy("doc_id").agg((F.sum(F.col("w") * F.col("idf")) / (F.first("norm") * F.first("nq"))).alias("score")).filter("score > 0")
    # three numbers of all scores instead of one window over all documents
    whole = scored.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"), F.sum("score").alias("total"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), F.round((F.col("score") - whole.select("mean").scalar()) / whole.select("dev").scalar(), 5).alias("z"), F.round(F.col("score") / whole.select("total").scalar(), 6).alias("part"))


def _shingle_vectors(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder).select("doc_id", X.shingles(F.col("text")).alias("s"))
    counts = R.term_counts(d, "doc_id", "s")
    n = load(spark, folder, "documents").filter("text IS NOT NULL").count()
    weighted = counts.join(R.probabilistic_idf(counts, "doc_id", n), "term").withColumn("w", F.log(F.lit(1.0) + F.col("c")) * F.col("idf"))
    return R.unit_vectors(weighted, "doc_id", "w")


def shingle_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each document's shingle vector and its number of shingles [T15 T16]."""
    return _shingle_vectors(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("norm"), 4).alias("norm"))


def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar documents of each whose id is divisible by 50, against all [T17 J14 O2]."""
    d = _docs(spark, folder).select(F.col("doc_id").cast("bigint").alias("doc"), X.letter_runs(F.col("text")).alias("words"))
    found = most_similar(d, "doc % 50 = 0", 5, _docs(spark, folder).count(), LISTED_TERMS)
    if found is not None:
        return found.select("query", "place", F.col("doc").alias("doc_id"), "score")
    v = cut(_shingle_vectors(spark, folder).select("doc_id", "term", "w", "norm"))
    scores = R.similar(v.filter("doc_id % 50 = 0"), v, "doc_id")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 5)), "doc_id")
    return scores.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("query", "place", "doc_id", F.round("score", 5).alias("score"))


def text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each text between lines of at most one character, with their lines and characters [T19]."""
    d = _docs(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = d.withColumn("block", F.sum((F.length("t") <= 1).cast("bigint")).over(w))
    return marked.filter(F.length("t") > 1).groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("t")).alias("chars"), F.min("line").alias("first_line"))


def regex_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a pattern matches, with its matches; a literal part is tried first [T26]."""
    return _docs(spark, folder).filter(F.contains("text", F.lit("def "))).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"def (\w+)\("), F.lit(1))).alias("hits")).filter("hits > 0")


def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Files by top-level module they import [T20 T21]."""
    return _imports(spark, folder).select(F.explode("m").alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("files"))


def _imports(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.top_level_imports(F.col("text")).alias("m")).filter("size(m) > 0")


def import_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Modules imported together, pairs counted inside each file's short list [A26 J12]."""
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: a != b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return _imports(spark, folder).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def path_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Files and characters by ending within each top folder, with folder and grand totals [A28 A34 T21 P27 P28 P31]."""
    d = load(spark, folder, "documents").filter("path IS NOT NULL AND NOT contains(path, '/node_modules/')").select(F.substring_index("path", "/", 2).alias("top"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("ending"), F.length("text").alias("n"))
    return d.rollup("top", "ending").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chars"))


def scaled_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts scaled to the largest of each ending, then the largest per word [A35 A36]."""
    d = _docs(spark, folder).filter("path IS NOT NULL").select(F.regexp_extract("path", r"\.(\w+)$", 1).alias("ext"), F.explode(X.words(F.col("text"))).alias("word"))
    c = d.groupBy("ext", "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    top = c.groupBy("ext").agg(F.max("n").alias("most"))
    scaled = c.join(top, "ext").withColumn("whole", top.agg(F.max("most")).scalar())
    return scaled.groupBy("word").agg(F.round(F.max(F.col("whole") * F.col("n") / F.col("most"))).cast("bigint").alias("n"))


def line_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where the first blank line stands, as shares of lines [T25]."""
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x)), "")
    return _docs(spark, folder).select("doc_id", F.size(lines).alias("lines"), F.round(F.when(at > 0, at / F.size(lines)), 6).alias("blank_at"))


def source_model(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior of each document's source by a unigram model over hashed words [T14]."""
    d = _docs(spark, folder).filter("source IS NOT NULL").select("doc_id", F.regexp_replace(F.lower(F.trim("source")), "-", "_").alias("source"), X.words(F.col("text")).alias("w")).filter("size(w) > 0")
    bins = d.select("doc_id", "source", F.explode("w").alias("t")).groupBy("doc_id", "source", F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint"), F.lit(BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    counts = bins.groupBy("source", "bin").agg(F.sum("c").alias("n"))
    total = counts.groupBy("source").agg(F.sum("n").alias("t"))
    alpha = 0.01
    # ln P(bin | source) of a bin that the source lacks is a constant of the source: only seen bins need rows
    seen = counts.join(total, "source").select(F.col("source").alias("s"), "bin", (F.log(F.col("n") + alpha) - F.log(F.lit(alpha))).alias("gain"))
    base = total.select(F.col("source").alias("s"), (F.log(F.lit(alpha)) - F.log(F.col("t") + alpha * BINS)).alias("low"))
    sizes = bins.groupBy("doc_id", F.col("source").alias("own")).agg(F.sum("c").alias("len"))
    seen = cut(seen)
    if seen.count() <= LISTED_ROWS:  # at most sources x BINS
        seen = F.broadcast(seen)
    gains = bins.join(seen, "bin").groupBy("doc_id", "s").agg(F.sum(F.col("c") * F.col("gain")).alias("g"))
    scored = gains.join(sizes, "doc_id").join(base, "s").withColumn("lp", F.col("g") + F.col("len") * F.col("low"))
    w = Window.partitionBy("doc_id")
    post = scored.withColumn("m", F.max("lp").over(w)).withColumn("p", F.exp(F.col("lp") - F.col("m")) / F.sum(F.exp(F.col("lp") - F.col("m"))).over(w))
    return post.groupBy("doc_id", "own").agg(F.max_by("s", F.struct("lp", "s")).alias("guess"), F.round(F.max("p"), 4).alias("p"))


def reservoir(spark: SparkSession, folder: str) -> DataFrame:
    """Five documents of each source, those with the smallest hashes: a sampling operator [A33 P8 X2]."""
    d = load(spark, folder, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    few = d.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))).filter("place <= 5")
    return few.select("source", "doc_id")


def corpus_split(spark: SparkSession, folder: str) -> DataFrame:
    """Train, validation and test parts by a hash of the repository, so that a repository is never cut [X1]."""
    part = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.coalesce("repo", F.lit("")))), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    name = F.when(part < 90, "train").when(part < 95, "validate").otherwise("test")
    return load(spark, folder, "documents").groupBy(name.alias("part")).agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("repo").alias("repos"))


def merges(spark: SparkSession, folder: str) -> DataFrame:
    """A byte-pair vocabulary of 100 merges, or up to the last pair that occurs twice [T23]."""
    words = _word_counts(spark, folder).groupBy("term").agg(F.sum("c").alias("n"))
    found = merge_vocabulary(cut(words), "term", "n", 100)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(found, 1)], "nth int, a string, b string")


def parts_together(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in one order, pairs counted inside the order's short list [A26 J12]."""
    baskets = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return baskets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def context_probability(spark: SparkSession, folder: str) -> DataFrame:
    """P(line status | return flag), P(return flag) above it, and lines and distinct orders of each level [A27 A28]."""
    c = load(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.grouping_id().alias("_g"))
    level = Window.partitionBy("_g", F.when(F.col("_g") == 0, F.col("l_returnflag")))  # flags and statuses are few
    return c.select("l_returnflag", "l_linestatus", "n", "orders", F.round(F.col("n") / F.sum("n").over(level), 6).alias("p"))


def flag_given_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """P(return flag | supplier) [A28 W5]."""
    c = load(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return c.select("l_suppkey", "l_returnflag", "n", F.round(share("n", "l_suppkey"), 6).alias("p"))


def coedit_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as files and orders as edits: scores against every part whose key is divisible by 50 [M9 J13]."""
    edges = load(spark, folder, "lineitem").select(F.col("l_partkey").alias("f"), F.col("l_orderkey").alias("e")).distinct()
    sized = edges.join(edges.groupBy("e").agg(F.count(F.lit(1)).alias("size")), "e")
    edit = sized.groupBy("f").agg(F.sum(F.lit(0.01) / F.col("size")).alias("edit"))
    base = sized.filter("f % 50 = 0").select(F.col("f").alias("base"), "e")
    co = sized.join(base, "e").groupBy("base", "f").agg(F.sum(F.lit(1.0) / F.col("size")).alias("co"))
    return co.join(edit, "f").select("base", "f", F.round(F.col("co") + F.col("edit"), 6).alias("score"))


def line_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Orders grouped by their shape: number of lines and sorted flags, with how many priorities they have, for shapes of two orders or more [A32]."""
    shape = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    o = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return shape.join(o, "l_orderkey").groupBy("lines", "flags").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("priorities")).filter("n >= 2")


def undeclared_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of a part in orders that no earlier order of it names, counted [J4]."""
    li = load(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    known = li.filter("l_shipdate < '1998-01-01'").select("l_partkey", "l_suppkey").distinct()
    return li.filter("l_shipdate >= '1998-01-01'").join(known, ["l_partkey", "l_suppkey"], "left_anti").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


def key_index(spark: SparkSession, folder: str) -> DataFrame:
    """A key-value index: all values of a key united, sorted, with their number [K12 S17]."""
    return load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ",").alias("parts"), F.count(F.lit(1)).alias("n"))


def _centres(e: DataFrame) -> DataFrame:
    """``label, c``: the mean vector of each label, one row per label."""
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def nearest_to_centre(spark: SparkSession, folder: str) -> DataFrame:
    """The three vectors of each label nearest to its centre [M3 O6]."""
    e = load(spark, folder, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "label", "embedding")
    gap = F.zip_with("embedding", "c", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
    d = e.join(_centres(e), "label").select("vec_id", "label", F.round(F.sqrt(_sum(gap)), 4).alias("distance"))
    w = Window.partitionBy("label").orderBy("distance", "vec_id")
    return d.withColumn("place", F.row_number().over(w)).filter("place <= 3")


def centre_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors assigned to the centre of highest cosine, against their labels: precision, recall and F1 [M10 M12]."""
    e = load(spark, folder, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "label", "embedding")
    # all centres are one value of labels x dimensions numbers
    every = _centres(e).agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("guess"), F.col("c"), F.sqrt(_sum(F.transform("c", lambda x: x * x))).alias("len")))).alias("every"))

    def match(k: Column) -> Column:
        dot = _sum(F.zip_with("embedding", k["c"], lambda x, c: x.cast("double") * c))
        return F.struct(F.round(dot / k["len"], 7).alias("cos"), (-k["guess"]).alias("g"), k["guess"].alias("guess"))

    best = e.withColumn("every", every.scalar()).filter("label IS NOT NULL").select("vec_id", "label", F.array_max(F.transform("every", match))["guess"].alias("guess"))
    found = best.groupBy(F.col("guess").alias("label")).agg(F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("guess") == F.col("label")).alias("hit"))
    truth = best.groupBy("label").agg(F.count(F.lit(1)).alias("relevant"))
    both = truth.join(found, "label", "left").withColumns({"retrieved": F.coalesce("retrieved", F.lit(0)).cast("bigint"), "hit": F.coalesce("hit", F.lit(0)).cast("bigint")})
    p, r = F.col("hit") / F.nullif("retrieved", F.lit(0)), F.col("hit") / F.col("relevant")
    return both.select("label", "relevant", "retrieved", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Expected against observed share of urgent orders in ten bins of a made score [M11 A44]."""
    o = load(spark, folder, "orders").select((F.col("o_totalprice") / 500000).alias("p"), F.col("o_orderpriority").startswith("1").cast("double").alias("y"))
    b = F.greatest(F.least(F.floor(F.col("p") * 10), F.lit(9)), F.lit(0)).cast("int")
    return o.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("expected"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.abs(F.avg("p") - F.avg("y")), 6).alias("error"))


def kmeans_groups(spark: SparkSession, folder: str) -> DataFrame:
    """K-means of the embeddings: cluster, members and weight [M1]."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = load(spark, folder, "embeddings").filter("embedding IS NOT NULL").select("vec_id", array_to_vector("embedding").alias("features"))
    n = v.count()
    if not n:
        return spark.createDataFrame([], "cluster int, members bigint, weight double")
    out = KMeans(k=10, seed=7, maxIter=20).fit(v).transform(v)
    return out.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("members"), F.round(F.count(F.lit(1)) / F.lit(n), 6).alias("weight"))


def code_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as vectors of 103 hashed words, clustered: of each cluster the features at least half of its texts have, and the three texts that have most of them [M2 M1]."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = _docs(spark, folder).select("doc_id", F.array_distinct(F.transform(X.words(F.col("text")), lambda t: F.pmod(F.xxhash64(t), F.lit(103)).cast("int"))).alias("h")).filter("size(h) > 0 AND doc_id IS NOT NULL")
    d = cut(d)
    out = "cluster int, members bigint, pattern string, snippets string"
    if d.limit(8).count() < 8:
        return spark.createDataFrame([], out)
    v = d.withColumn("features", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(102)), lambda i: F.array_contains("h", i).cast("double"))))
    placed = cut(KMeans(k=8, seed=7, maxIter=10).fit(v.select("features")).transform(v).select("doc_id", "h", F.col("prediction").alias("cluster")))
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    common = placed.select("cluster", F.explode("h").alias("f")).groupBy("cluster", "f").agg(F.count(F.lit(1)).alias("n")).join(sizes, "cluster").filter("2 * n >= members")
    patterns = common.groupBy("cluster").agg(F.array_sort(F.collect_list("f")).alias("p"))
    best = placed.join(patterns, "cluster").select("cluster", "doc_id", F.size(F.array_intersect("h", "p")).alias("k"))
    top = best.withColumn("i", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("k"), "doc_id"))).filter("i <= 3").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "doc_id"))).alias("t"))
    return sizes.join(patterns, "cluster", "left").join(top, "cluster", "left").select("cluster", "members", F.coalesce(F.array_join("p", ","), F.lit("")).alias("pattern"), F.coalesce(F.array_join(F.transform("t", lambda t: t["doc_id"].cast("string")), ","), F.lit("")).alias("snippets"))


def principal_axes(spark: SparkSession, folder: str) -> DataFrame:
    """The five principal axes of the vectors, and the share of variance each explains [M12]."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = load(spark, folder, "embeddings").filter("embedding IS NOT NULL").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    if v.limit(6).count() < 6:
        return spark.createDataFrame([], "axis int, part double")
    model = PCA(k=5, inputCol="features", outputCol="p").fit(v)
    return spark.createDataFrame([(i, float(round(x, 6))) for i, x in enumerate(model.explainedVariance.toArray(), 1)], "axis int, part double")


def type_induction(spark: SparkSession, folder: str) -> DataFrame:
    """Types of parts' suppliers by the flags their lines show, by expectation maximisation [M7]."""
    li = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("var"), (F.col("l_orderkey") % 7).alias("func")).agg(F.collect_set("l_returnflag").alias("attrs"))
    types = spark.createDataFrame([("sale", "A"), ("sale", "N"), ("return", "R"), ("return", "A"), ("all", "A"), ("all", "N"), ("all", "R")], "type string, attr string")
    func_p, _, _ = induce_types(li, types, steps=3)
    return func_p.select("func", "type", F.round("p", 4).alias("p"))


def conversion_model(spark: SparkSession, folder: str) -> DataFrame:
    """A logistic model of big orders fitted with cross-validation, means imputed: ranking and precision areas [M6]."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    inputs = ["balance", "nation", "parts"]
    li = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("parts"))
    c = load(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    rows = load(spark, folder, "orders").filter("o_totalprice IS NOT NULL").join(c, "o_custkey", "left").join(li, "o_orderkey", "left").select(*inputs, (F.col("o_totalprice") > 250000).cast("double").alias("label"))
    out = "metric string, value double"
    rows = cut(rows)
    if rows.select("label").distinct().count() < 2:
        return spark.createDataFrame([], out)
    filled = [f"{x}_" for x in inputs]
    model = LogisticRegression(maxIter=20)
    steps = Pipeline(stages=[Imputer(inputCols=inputs, outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="features"), model])
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1]).build()
    fitted = CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=3, seed=7).fit(rows)
    scored = fitted.transform(rows)
    found = [(m, round(float(BinaryClassificationEvaluator(metricName=m).evaluate(scored)), 4)) for m in ("areaUnderROC", "areaUnderPR")]
    return spark.createDataFrame([*found, ("cross-validated", round(float(max(fitted.avgMetrics)), 4))], out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dedupe_by_content, token_frequency, top_tokens, split_name_tokens, ngram_counts, stem_counts, normalised_lengths, page_words, idf_weights, tf_weights, query_scores, shingle_weights, similar_documents,
        text_blocks, regex_search, import_counts, import_pairs, path_rollup, scaled_word_counts, line_positions, source_model, reservoir, corpus_split, merges, parts_together, context_probability,
        flag_given_supplier, coedit_scores, line_patterns, undeclared_keys, key_index, nearest_to_centre, centre_agreement, calibration, kmeans_groups, conversion_model, type_induction, code_patterns, principal_axes,
    )
}

_W = r"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)"
_SH = r"""d AS (SELECT doc_id, replace(lower(text), '_', '') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_filter(list_transform(range(1, greatest(length(t) - 4, 1) + 1), lambda i: substr(t, i, 5)), lambda x: regexp_full_match(x, '\p{L}{5}'))) AS term FROM d),
c AS (SELECT doc_id, term, count(*) AS c FROM s GROUP BY ALL), n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
v AS (SELECT doc_id, term, ln(1 + c) * ln((n - df) / df) AS w FROM c JOIN f USING (term), n WHERE df * 2 < n), l AS (SELECT doc_id, count(*) AS k, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1)"""
_IMPORTS = r"""i AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?m)^[ \t]*import[ \t]+([A-Za-z_]\w*)', 1), regexp_extract_all(text, '(?m)^[ \t]*from[ \t]+([A-Za-z_]\w*)[\w.]*[ \t]+import\b', 1)))) AS m FROM documents WHERE text IS NOT NULL)"""
_AT = "a AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL), k AS (SELECT label, i, avg(x) AS c FROM a GROUP BY ALL)"

SQL: dict[str, str] = {
    "dedupe_by_content": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "token_frequency": f"WITH {_W} SELECT term, CAST(sum(c) AS BIGINT) AS n, count(*) AS docs FROM c GROUP BY 1",
    "top_tokens": rf"WITH d AS (SELECT coalesce(lower(lang[1:2]), '') AS lang, unnest(list_filter(regexp_extract_all(lower(text), '\w+'), lambda t: t NOT IN ({', '.join(repr(x) for x in X.STOP_WORDS)}))) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT lang, term, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS place FROM c) SELECT * FROM r WHERE place <= 20",
    "split_name_tokens": r"SELECT unnest(regexp_extract_all(lower(replace(regexp_replace(text, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '_', ' ')), '[\p{L}\p{N}]+')) AS term, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "ngram_counts": r"WITH w AS (SELECT regexp_extract_all(lower(text), '\w+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "normalised_lengths": r"SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes, CAST(length(text) - length(regexp_replace(text, '[`\[\]]', '', 'g')) AS INTEGER) AS quotes FROM documents WHERE text IS NOT NULL",
    "page_words": r"""SELECT unnest(regexp_extract_all(lower(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')), '\w+')) AS term, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "idf_weights": f"WITH {_W} SELECT term, count(*) AS df, round(log10(any_value(n) / count(*)), 6) AS idf FROM c, n GROUP BY 1",
    "tf_weights": f"WITH {_W} SELECT doc_id, term, round(c / sum(c) OVER p, 6) AS tf, round(0.5 + 0.5 * c / max(c) OVER p, 6) AS tf_short FROM c WINDOW p AS (PARTITION BY doc_id)",
    "query_scores": f"""WITH {_W}, i AS (SELECT term, log10(any_value(n) / count(*)) AS idf FROM c, n GROUP BY 1), v AS (SELECT doc_id, term, idf, c / sum(c) OVER (PARTITION BY doc_id) * idf AS w FROM c JOIN i USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
q AS (SELECT sqrt(sum(idf * idf)) AS nq FROM i WHERE term IN ({', '.join(repr(t) for t in QUERY.split())})), s AS (SELECT doc_id, sum(w * idf) / (any_value(norm) * any_value(nq)) AS score FROM v JOIN l USING (doc_id), q WHERE term IN ({', '.join(repr(t) for t in QUERY.split())}) GROUP BY 1), p AS (SELECT * FROM s WHERE score > 0)
SELECT doc_id, round(score, 6) AS score, round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 5) AS z, round(score / sum(score) OVER (), 6) AS part FROM p""",
    "shingle_weights": f"WITH {_SH} SELECT doc_id, k AS n, round(norm, 4) AS norm FROM l",
    "similar_documents": f"WITH {_SH}, p AS (SELECT q.doc_id AS query, v.doc_id, sum(q.w * v.w) AS dot FROM v q JOIN v USING (term) WHERE q.doc_id % 50 = 0 AND q.doc_id <> v.doc_id GROUP BY ALL), r AS (SELECT query, p.doc_id, round(dot / ((a.norm + 10) * b.norm), 5) AS score FROM p JOIN l a ON a.doc_id = query JOIN l b ON b.doc_id = p.doc_id), o AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS place, doc_id, score FROM r) SELECT * FROM o WHERE place <= 5",
    "text_blocks": "WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL), m AS (SELECT *, sum((length(t) <= 1)::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS block FROM d) SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(min(line) AS INTEGER) AS first_line FROM m WHERE length(t) > 1 GROUP BY ALL",
    "regex_search": r"SELECT doc_id, CAST(len(regexp_extract_all(text, 'def (\w+)\(', 1)) AS INTEGER) AS hits FROM documents WHERE len(regexp_extract_all(text, 'def (\w+)\(', 1)) > 0",
    "import_counts": f"WITH {_IMPORTS} SELECT unnest(m) AS module, count(*) AS files FROM i GROUP BY 1",
    "import_pairs": f"WITH {_IMPORTS}, x AS (SELECT doc_id, unnest(m) AS a FROM i) SELECT x.a, y.a AS b, count(*) AS n FROM x JOIN x y USING (doc_id) WHERE x.a <> y.a GROUP BY ALL",
    "path_rollup": r"WITH d AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS top, regexp_extract(path, '\.(\w+)$', 1) AS ending, length(text) AS n FROM documents WHERE path IS NOT NULL AND NOT contains(path, '/node_modules/')) SELECT top, ending, count(*) AS files, CAST(sum(n) AS BIGINT) AS chars FROM d GROUP BY ROLLUP (top, ending)",
    "scaled_word_counts": r"WITH d AS (SELECT regexp_extract(path, '\.(\w+)$', 1) AS ext, unnest(regexp_extract_all(lower(text), '\w+')) AS word FROM documents WHERE text IS NOT NULL AND path IS NOT NULL), c AS (SELECT ext, word, count(*) AS n FROM d GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT ext, max(n) AS most FROM c GROUP BY 1), a AS (SELECT max(most) AS w FROM t) SELECT word, CAST(round(max(w * n / most)) AS BIGINT) AS n FROM c JOIN t USING (ext), a GROUP BY 1",
    "line_positions": "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, len(l) AS lines, coalesce(list_position(list_transform(l, lambda x: trim(x)), ''), 0) AS pos FROM d) SELECT doc_id, CAST(lines AS INTEGER) AS lines, round(CASE WHEN pos > 0 THEN pos / lines END, 6) AS blank_at FROM p",
    "reservoir": "SELECT coalesce(source, '') AS source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 5",
    "corpus_split": "WITH d AS (SELECT repo, CAST(concat('0x', md5('7:' || coalesce(repo, ''))[1:8]) AS BIGINT) % 100 AS p FROM documents) SELECT CASE WHEN p < 90 THEN 'train' WHEN p < 95 THEN 'validate' ELSE 'test' END AS part, count(*) AS docs, count(DISTINCT repo) AS repos FROM d GROUP BY 1",
    "parts_together": "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM e x JOIN e y USING (l_orderkey) WHERE x.l_partkey < y.l_partkey GROUP BY ALL",
    "context_probability": "WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, GROUPING(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) SELECT l_returnflag, l_linestatus, n, orders, round(n / sum(n) OVER (PARTITION BY g, CASE WHEN g = 0 THEN l_returnflag END), 6) AS p FROM c",
    "flag_given_supplier": "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY l_suppkey), 6) AS p FROM c",
    "coedit_scores": "WITH e AS (SELECT DISTINCT l_partkey AS f, l_orderkey AS e FROM lineitem), s AS (SELECT f, e, count(*) OVER (PARTITION BY e) AS size FROM e), t AS (SELECT f, sum(0.01 / size) AS edit FROM s GROUP BY 1), c AS (SELECT b.f AS base, s.f, sum(1 / s.size) AS co FROM s JOIN s b USING (e) WHERE b.f % 50 = 0 GROUP BY ALL) SELECT base, f, round(co + edit, 6) AS score FROM c JOIN t USING (f)",
    "line_patterns": "WITH s AS (SELECT l_orderkey, count(*) AS lines, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1) SELECT lines, flags, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) >= 2",
    "undeclared_keys": "WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01') SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem l WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM k WHERE k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey) GROUP BY 1",
    "key_index": "SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS parts, count(*) AS n FROM lineitem GROUP BY 1",
    "nearest_to_centre": f"WITH {_AT}, d AS (SELECT vec_id, label, round(sqrt(sum((x - c) ** 2)), 4) AS distance FROM a JOIN k USING (label, i) GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS INTEGER) AS place FROM d) SELECT * FROM r WHERE place <= 3",
    "centre_agreement": f"""WITH {_AT}, l AS (SELECT label AS guess, sqrt(sum(c * c)) AS len FROM k GROUP BY 1), d AS (SELECT vec_id, a.label, k.label AS guess, sum(x * c) AS dot FROM a JOIN k USING (i) GROUP BY ALL), b AS (SELECT vec_id, label, guess FROM d JOIN l USING (guess) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(dot / len, 7) DESC, guess) = 1),
t AS (SELECT label, count(*) AS relevant FROM b GROUP BY 1), f AS (SELECT guess AS label, count(*) AS retrieved, count_if(guess = label) AS hit FROM b GROUP BY 1), j AS (SELECT label, relevant, coalesce(retrieved, 0) AS retrieved, coalesce(hit, 0) AS hit FROM t LEFT JOIN f USING (label)), m AS (SELECT *, hit / nullif(retrieved, 0) AS p, hit / relevant AS r FROM j)
SELECT label, relevant, CAST(retrieved AS BIGINT) AS retrieved, round(coalesce(p, 0), 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m""",
    "calibration": "WITH o AS (SELECT o_totalprice / 500000 AS p, (o_orderpriority LIKE '1%')::INT AS y FROM orders) SELECT CAST(greatest(least(floor(p * 10), 9), 0) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS expected, round(avg(y), 6) AS observed, round(abs(avg(p) - avg(y)), 6) AS error FROM o GROUP BY 1",
}
