"""Benchmark decontamination by templates, by built-in SQL functions only.

A text's words are its runs of letters and marks, in lower case; runs of decimal digits of any script are
the placeholder NUMBER, and a unit after a number is UNIT. Two templates are made of them: the plain one, which
doesn't know names, so that copies in upper or lower case have the item's own, and the named one, in which each
run of capitalised words, wherever it stands, is the placeholder NAME. A word that is capitalised only because
it begins a sentence is a name on both sides and maps to itself.

Windows of five template words are hashed and joined with the benchmark's; windows of placeholders alone say
nothing of a text and are left out. A document is contaminated by an item if, in one of the templates, it holds
at least `least` of the item's different windows and its slots are consistent: along the best alignment, at least
`least` of the placeholders follow one mapping from the item's values to the document's, as a copy or a question
with other parameters does and an accidental likeness doesn't. A name's value is the last word of its run.

Whoever holds `least` of an item's windows holds one of any n - ceil(least * n) + 1 of them; so only documents
with one of the item's rarest windows are compared with it, and windows that many documents share make no rows.

Null texts, empty texts and empty tables have no windows and give no rows. An item with fewer than five template
words has one window of all; documents then get windows of that many words as well, so that it is found as a passage, however
common its words are. Very long
texts only cost their length; no pattern backtracks or recurses. Null ids never match. Of rows with one
doc_id each text is judged by itself and the best match is reported, in doubt of the plain template; equal rows
count once. Items that are repeated or alike are reported each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

WIDTH, LEAST = 5, 0.8
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Words that are units after a number.
UNITS = """
mm cm km kg mg ml kwh mph kph hz khz mhz ghz kb mb gb tb usd eur gbp percent dollars dollar euros euro cents cent
pounds pound miles mile metres meters metre meter feet foot inches inch grams gram litres liters hours hour minutes
minute seconds second days day weeks week months month years year degrees degree
""".split()
_LONGEST_FIRST = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
NUMBER_RE = r"([0-9\p{Nd}][0-9\p{Nd}.,]*+)"
#: A capital at the beginning of a word, before a small letter. The look-behind has a fixed length.
CAPITAL_RE = r"(\p{Lu})(?=\p{Ll})(?<![\p{L}\p{M}]\p{Lu})"
UNIT_RE = rf"{NUMBER} {{1,2}}{NAME}?(%|(?:{_LONGEST_FIRST})(?![\p{{L}}\p{{M}}]))"
TOKEN_RE = rf"[{NUMBER}{UNIT}]|{NAME}?[a-z\p{{L}}\p{{M}}]++"


def _numbered(text: Column) -> Column:
    """The text in lower case with numbers replaced and a mark before each capitalised word."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, NUMBER_RE, f" {NUMBER} "), CAPITAL_RE, f"{NAME}$1"))


def tokens(text: Column) -> Column:
    """Array of the text's words; capitalised ones begin with NAME."""
    return F.regexp_extract_all(F.regexp_replace(_numbered(text), UNIT_RE, f"{NUMBER} {UNIT} "), F.lit(TOKEN_RE), F.lit(0))


def _names_once(words: str) -> Column:
    """Of each run of capitalised words the last."""
    capital = lambda w: F.startswith(w, F.lit(NAME))
    return F.filter(words, lambda w, i: ~(capital(w) & F.coalesce(capital(F.get(F.col(words), i + 1)), F.lit(False))))


def _plain(words: str) -> Column:
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit(NAME)), F.substring(w, F.lit(2), F.length(w))).otherwise(w))


def _named(words: str) -> Column:
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit(NAME)), F.lit(NAME)).otherwise(w))


def templates(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of df, then plain and named, the template words, and once, the words that named is of."""
    keep = [c for c in df.columns if c != text]
    found = df.filter(F.col(text).isNotNull()).select(*keep, tokens(F.col(text)).alias("words"))
    once = found.select(*keep, "words", _names_once("words").alias("once"))
    return once.select(*keep, "once", _plain("words").alias("plain"), _named("once").alias("named"))


def _hashed(words: str, kind: int, width: int = WIDTH, item: bool = False) -> Column:
    """Hashes of all windows of that width in their order; an item with fewer words has one window of all."""
    n = F.size(words)
    whole = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    at = whole if item else F.when(n >= width, whole).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(kind), F.slice(words, i, width)))


def _window_rows(df: DataFrame, widths: Sequence[int] = ()) -> DataFrame:
    """The other columns of df, then named, pos and h of each window that holds a word: of documents with all widths, else of items."""
    keep = [c for c in df.columns if c != "text"]

    def of(words: str, kind: int, width: int) -> Column:
        said = lambda i: F.exists(F.slice(words, i + 1, width), lambda w: ~w.isin(NUMBER, NAME, UNIT))
        hashes = _hashed(words, kind, width, not widths)
        return F.transform(hashes, lambda h, i: F.struct(F.lit(bool(kind)).alias("named"), i.alias("pos"), h.alias("h"), said(i).alias("says")))

    some = F.when(F.size("plain") > 0, F.concat(*(of(words, kind, w) for kind, words in enumerate(("plain", "named")) for w in widths or (WIDTH,))))
    rows = templates(df).select(*keep, F.explode(some).alias("w")).select(*keep, "w.*")
    return rows.filter("says").drop("says")


def _slots(df: DataFrame) -> DataFrame:
    """The other columns of df, then named, pos, kind and value of each placeholder; the k-th number or unit has the k-th value in the text."""
    keep = [c for c in df.columns if c != "text"]
    low = _numbered(F.col("text"))
    told = {"numbers": F.regexp_extract_all("text", F.lit(NUMBER_RE), F.lit(1)), "units": F.regexp_extract_all(low, F.lit(UNIT_RE), F.lit(1))}
    forms = templates(df.withColumns(told).select(*keep, *told, "text"))
    forms = forms.select(*keep, *told, F.explode(F.array(F.struct(F.lit(False).alias("named"), F.col("plain").alias("words")), F.struct(F.lit(True).alias("named"), F.col("once").alias("words")))).alias("f"))
    forms = forms.select(*keep, *told, "f.named", "f.words")

    def of(kind: str, values: Column) -> Column:
        marks = F.filter(F.transform("words", lambda w, i: F.when(F.startswith(w, F.lit(kind)), i)), lambda i: i.isNotNull())
        both = F.zip_with(marks, values, lambda i, v: F.struct(i.alias("pos"), F.lit(kind).alias("kind"), F.regexp_replace(v, "[.,]+$", "").alias("value")))
        return F.filter(both, lambda z: z["pos"].isNotNull())

    names = F.transform(F.filter("words", lambda w: F.startswith(w, F.lit(NAME))), lambda w: F.substring(w, F.lit(2), F.length(w)))
    every = F.concat(of(NUMBER, F.col("numbers")), of(UNIT, F.col("units")), of(NAME, names))
    return forms.select(*keep, "named", F.explode(every).alias("slot")).select(*keep, "named", "slot.*")


def judged(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, text_hash, item_id, named, n_windows, n_found, n_slots, n_consistent of each contaminated text, its item and template."""
    key = ["doc_id", "text_hash"]
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id", "text").agg(F.lit(1)).select("item_id", "text")
    own = written(_window_rows(items).distinct(), "decon-items")
    n = own.count()  # bounds every table made of the benchmark alone
    short = templates(items).select(F.explode(F.array(F.size("plain"), F.size("named"))).alias("n")).filter(F.col("n").between(1, WIDTH - 1))
    widths = [*sorted(r.n for r in short.distinct().collect()), WIDTH]  # four short ones at most
    forms = templates(rows)
    hashes = F.explode(F.when(F.size("plain") > 0, F.concat(*(_hashed(words, kind, w) for kind, words in enumerate(("plain", "named")) for w in widths))))
    hits = written(forms.select(*key, hashes.alias("h")).join(bounded(own.select("h").distinct(), n), "h"), "decon-hits")
    # Candidates: whoever holds one of an item's rarest windows, so many that none can miss them all.
    part = ["item_id", "named"]
    often = hits.groupBy("h").agg(F.count("*").alias("often"))
    places = own.select(*part, "h").distinct()
    sizes = places.groupBy(*part).agg(F.count("*").alias("n_windows"), F.collect_list("h").alias("hs"))
    rarest = F.row_number().over(Window.partitionBy(*part).orderBy(F.coalesce("often", F.lit(0)), "h"))
    anchors = places.join(bounded(often, n), "h", "left").withColumn("nth", rarest).join(bounded(sizes.select(*part, "n_windows"), n), part)
    anchors = anchors.filter(F.col("nth") <= F.col("n_windows") - F.ceil(F.col("n_windows") * least) + 1).select(*part, "h")
    pairs = hits.join(bounded(anchors, n), "h").select(*key, *part).distinct()
    held = hits.groupBy(*key).agg(F.collect_set("h").alias("held"))
    shared = F.size(F.array_intersect("hs", "held")).cast("long")
    counted = pairs.join(bounded(sizes, n), part).join(held, key).select(*key, *part, "n_windows", shared.alias("n_found"))
    found = written(counted.filter(F.col("n_found") >= F.col("n_windows") * least), "decon-found")
    # Slots, of found texts alone.
    texts = rows.join(bounded(found.select(*key).distinct()), key, "left_semi").dropDuplicates(key)
    met = found.select(*key, *part).join(_window_rows(texts, widths), [*key, "named"]).withColumnRenamed("pos", "at").join(bounded(own, n), [*part, "h"])
    aligned = met.groupBy(*key, *part, (F.col("at") - F.col("pos")).alias("shift")).agg(F.count_distinct("pos").alias("n"))
    aligned = aligned.groupBy(*key, *part).agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    asked = _slots(items).withColumnRenamed("value", "asked")
    said = _slots(texts).withColumnsRenamed({"pos": "at", "value": "said"})
    votes = aligned.join(bounded(asked, n), part).withColumn("at", F.col("pos") + F.col("shift")).join(said, [*key, "named", "at", "kind"])
    votes = votes.groupBy(*key, *part, "kind", "asked", "said").agg(F.count("*").alias("n")).groupBy(*key, *part, "kind", "asked").agg(F.sum("n").alias("n"), F.max("n").alias("best"))
    votes = votes.groupBy(*key, *part).agg(F.sum("n").alias("n_slots"), F.sum("best").alias("n_consistent"))
    tally = found.join(votes, [*key, *part], "left").na.fill(0, ["n_slots", "n_consistent"])
    return tally.filter(F.col("n_consistent") >= F.col("n_slots") * least).select(*key, *part, "n_windows", "n_found", "n_slots", "n_consistent")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, n_slots, n_consistent of each contaminated document and its item."""
    figures = ["n_windows", "n_found", "n_slots", "n_consistent"]
    best = F.max(F.struct((F.col("n_found") / F.col("n_windows")).alias("share"), (~F.col("named")).alias("plain"), *figures)).alias("best")
    return judged(docs, benchmark, least).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *(f"best.{c}" for c in figures))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs whose text no item contaminates; rows with a null id stay."""
    bad = written(judged(docs, benchmark, least).select("doc_id", F.col("text_hash").alias("_bad")).distinct(), "decon-bad").alias("b")
    same = (F.col("d.doc_id") == F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b._bad"))
    return docs.alias("d").join(bounded(bad).alias("b"), same, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    """DuckDB SQL for contaminated() over the tables documents and benchmark. RE2 has no look-around: names are told word by word."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    number = r"([0-9\p{Nd}][0-9\p{Nd}.,]*)"
    unit = rf"(?i){NUMBER} {{1,2}}(?:(%)|({_LONGEST_FIRST})([^\p{{L}}\p{{M}}]|$))"
    token = rf"[{NUMBER}{UNIT}]|[\p{{L}}\p{{M}}]+"
    capital = lambda w: rf"regexp_matches({w}, '^\p{{Lu}}\p{{Ll}}')"
    leads = [f"lead(w0, {i}) OVER x" for i in range(WIDTH)]
    return rf"""
WITH base AS (
  SELECT DISTINCT 'd' AS side, doc_id AS k, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), a AS (
  SELECT *, row_number() OVER () AS r, regexp_replace(text, {q(number)}, ' {NUMBER} ', 'g') AS numbered FROM base
), b AS (
  SELECT *, regexp_extract_all(regexp_replace(numbered, {q(unit)}, '{NUMBER} {UNIT} \3', 'g'), {q(token)}) AS t FROM a
), c AS (
  SELECT *, list_filter(list_transform(list_zip(t, t[2:]), lambda z: CASE WHEN {capital("z[1]")} THEN CASE WHEN coalesce({capital("z[2]")}, FALSE) THEN '' ELSE '{NAME}' || lower(z[1]) END ELSE lower(z[1]) END), lambda w: w <> '') AS once FROM b
), form AS (
  SELECT side, k, r, FALSE AS named, list_transform(t, lambda w: lower(w)) AS words, list_transform(t, lambda w: lower(w)) AS raw FROM c
  UNION ALL SELECT side, k, r, TRUE, list_transform(once, lambda w: CASE WHEN w[1] = '{NAME}' THEN '{NAME}' ELSE w END), once FROM c
), every AS (
  SELECT side, k, r, named, pos, pos <= greatest(n - {WIDTH}, 0) AS whole, concat_ws(' ', {", ".join(leads)}) AS g, ({" OR ".join(f"coalesce({x} NOT IN ('{NUMBER}', '{NAME}', '{UNIT}'), FALSE)" for x in leads)}) AS says
  FROM (SELECT side, k, r, named, len(words) AS n, unnest(words) AS w0, generate_subscripts(words, 1) - 1 AS pos FROM form)
  WINDOW x AS (PARTITION BY r, named ORDER BY pos)
), w AS (SELECT * FROM every WHERE whole
), iw AS (SELECT DISTINCT k AS item_id, named, pos, g FROM w WHERE side = 'i' AND says
), sizes AS (SELECT item_id, named, count(DISTINCT g) AS n_windows FROM iw GROUP BY ALL
), found AS (
  SELECT doc_id, r, item_id, named, n_windows, n_found FROM (
    SELECT d.k AS doc_id, d.r, i.item_id, named, count(*) AS n_found FROM (SELECT DISTINCT k, r, named, g FROM w WHERE side = 'd') d JOIN (SELECT DISTINCT item_id, named, g FROM iw) i USING (named, g) GROUP BY ALL
  ) JOIN sizes USING (item_id, named) WHERE n_found >= n_windows * {LEAST}::DOUBLE
), shifts AS (
  SELECT f.doc_id, f.r, f.item_id, f.named, d.pos - i.pos AS shift, count(DISTINCT i.pos) AS n
  FROM found f JOIN w d ON d.side = 'd' AND d.r = f.r AND d.named = f.named JOIN iw i ON i.item_id = f.item_id AND i.named = f.named AND i.g = d.g GROUP BY ALL
), aligned AS (
  SELECT doc_id, r, item_id, named, shift FROM shifts QUALIFY row_number() OVER (PARTITION BY r, item_id, named ORDER BY n DESC, shift) = 1
), marks AS (
  SELECT side, k, r, named, pos, kind, word, row_number() OVER (PARTITION BY r, named, kind ORDER BY pos) AS nth FROM (
    SELECT side, k, r, named, word[1] AS kind, word, pos FROM (SELECT side, k, r, named, unnest(raw) AS word, generate_subscripts(raw, 1) - 1 AS pos FROM form WHERE side = 'i' OR r IN (SELECT r FROM found))
  ) WHERE kind IN ('{NUMBER}', '{NAME}', '{UNIT}')
), slots AS (
  SELECT m.side, m.k, m.r, m.named, m.pos, m.kind, regexp_replace(CASE m.kind WHEN '{NAME}' THEN m.word[2:] WHEN '{NUMBER}' THEN regexp_extract_all(a.text, {q(number)}, 1)[nth]
    ELSE lower(coalesce(nullif(regexp_extract_all(a.numbered, {q(unit)}, 1)[nth], ''), regexp_extract_all(a.numbered, {q(unit)}, 2)[nth])) END, '[.,]+$', '') AS value
  FROM marks m JOIN a USING (r)
), votes AS (
  SELECT doc_id, l.r, item_id, l.named, i.kind, i.value AS asked, s.value AS said, count(*) AS n
  FROM aligned l JOIN slots i ON i.side = 'i' AND i.k = item_id AND i.named = l.named JOIN slots s ON s.side = 'd' AND s.r = l.r AND s.named = l.named AND s.kind = i.kind AND s.pos = i.pos + shift GROUP BY ALL
), tally AS (
  SELECT r, item_id, named, sum(n)::BIGINT AS n_slots, sum(best)::BIGINT AS n_consistent FROM (SELECT r, item_id, named, kind, asked, sum(n) AS n, max(n) AS best FROM votes GROUP BY ALL) GROUP BY ALL
), passed AS (
  SELECT doc_id, item_id, named, n_windows, n_found, coalesce(n_slots, 0) AS n_slots, coalesce(n_consistent, 0) AS n_consistent FROM found LEFT JOIN tally USING (r, item_id, named)
)
SELECT doc_id, item_id, n_windows, n_found, n_slots, n_consistent FROM passed WHERE n_consistent >= n_slots * {LEAST}::DOUBLE
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_found / n_windows DESC, named, n_windows DESC, n_found DESC, n_slots DESC, n_consistent DESC) = 1
"""
