"""The registered queries over the test tables.

There is no real word list here, so the lexicons come from the documents: tokens
of English texts, and transliterated tokens of Spanish ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scriptmill.functions import abbreviations, mapping, tokens
from scriptmill.operators import correct, fold, lookup, replay, scan, scores, similar, speller, timeline
from scriptmill.sources import events, lexicons
from scriptmill.sources.shared import shared_path, spread, stored
from scriptmill.streaming import detect


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of one row group is one task's work; the words made of it are not."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def _blank_split(docs: DataFrame) -> DataFrame:
    """Runs between blanks, as doc_id, lang and token."""
    return docs.select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"([^ \t\r\n]+)"), 1)).alias("token"))


def _words(docs: DataFrame) -> DataFrame:
    """Keyboard tokens as doc_id, lang, pos (from 0) and word."""
    return docs.select("doc_id", "lang", F.posexplode(tokens.segments(F.col("text"))).alias("pos", "word"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words by language, with how many there are and the last position of any, as a stored table: the texts are read once for all that is derived from them."""
    words = _words(_docs(spark, sf_dir)).groupBy("lang", "word")
    return stored(words.agg(F.count("*").alias("n"), F.max("pos").alias("last")), "counted")


def _by_word(counted: DataFrame) -> DataFrame:
    """word and n_rows of ``counted``, as operators.lookup.counted."""
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n_rows")), "words")


def _lexicons(spark: SparkSession, sf_dir: str, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both lexicons as stored tables, as word lists would be; from the texts or from ``counted``."""
    docs = _docs(spark, sf_dir)
    en, bg = (lexicons.english_of(counted), lexicons.bulgarian_of(counted)) if counted is not None else (lexicons.derive_english(docs), lexicons.derive_bulgarian(docs))
    return stored(en, "lexicon-en"), stored(bg, "lexicon-bg")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole conversations: session, pos (from 0 over all turns) and word."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session"), "turn", "role", F.posexplode(tokens.segments(F.col("text"))).alias("at", "word"))
    order = W.partitionBy("session").orderBy("turn", "role", "at")
    return rows.select("session", (F.row_number().over(order) - 1).alias("pos"), "word")


#: Languages of the documents that stand in for Bulgarian and (with the factor that it has) Russian.
BULGARIAN_LIKE = {"es": 1.0, "fr": 0.4}
#: Occurrences from which a word of English documents counts as a word to be meant.
FREQUENT = 5


def _recogniser(counted: DataFrame) -> scores.Recogniser:
    return scores.train(counted.select("lang", "word", "n"), {"en": 1.0}, BULGARIAN_LIKE)


def _frequent(counted: DataFrame) -> DataFrame:
    """English words with their frequency, without rare ones."""
    words = counted.filter("lang = 'en'").groupBy(F.lower("word").alias("word"))
    return stored(words.agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "frequent")


def translit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _blank_split(_docs(spark, sf_dir)).groupBy("token").agg(F.count("*").alias("n"))
    latin = mapping.is_latin_word(F.col("token"))
    return counted.select("token", latin.alias("is_latin"), F.when(latin, mapping.to_cyrillic(F.col("token"))).alias("cyrillic"), mapping.contains_cyrillic(F.col("token")).alias("has_cyrillic"), "n")


def token_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("token")
    flags = {
        "n_address": tokens.is_email_or_url(tokens.stem(t)),
        "n_emoticon": tokens.is_emoticon(t),
        "n_prefix": tokens.is_emoticon_prefix(t),
        "n_body": tokens.is_emoticon_body(t),
        "n_trailing": tokens.trailing(t) != "",
        "n_hyphen": tokens.stem(t).contains("-"),
        "n_special_first": tokens.key_class(F.substring(t, 1, 1)) == "special",
        "n_other_first": tokens.key_class(F.substring(t, 1, 1)) == "other",
    }
    return _blank_split(_docs(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(v.cast("bigint")).alias(k) for k, v in flags.items()])


def segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_docs(spark, sf_dir)).select("doc_id", "pos", "word")


def abbrev_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    words = _words(_docs(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))
    words = words.select("word", abbreviations.expand_english(w).alias("english"), correct.correct_english(w).alias("english_cased"), abbreviations.expand_bulgarian(w).alias("bulgarian"), "n")
    return words.filter("english is not null or bulgarian is not null")


def case_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(_docs(spark, sf_dir)).select("word").distinct()
    return words.select("word", tokens.restore_case(F.col("word"), mapping.to_cyrillic(F.lower("word"))).alias("restored"))


def lexicon_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    en, bg = lexicons.derive_english(docs), lexicons.derive_bulgarian(docs)
    return en.select(F.lit("en").alias("lexicon"), "word").union(bg.select(F.lit("bg").alias("lexicon"), "word"))


def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lexicons, written as word lists and read from the files."""
    docs, base = _docs(spark, sf_dir), shared_path(spark, "lists")
    found = {"en": lexicons.derive_english(docs), "bg": lexicons.derive_bulgarian(docs)}
    for name, words in found.items():
        lexicons.write_lexicon(words, f"{base}/{name}.txt")
    en, bg = (lexicons.read_lexicon(spark, f"{base}/{name}.txt").select(F.lit(name).alias("lexicon"), "word") for name in found)
    return en.union(bg)


def lexicon_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by document language and lexicon class."""
    counted = _counted(spark, sf_dir)
    classed = lookup.classify(counted.select("lang", "word", "n"), *_lexicons(spark, sf_dir, counted))
    return classed.groupBy("lang", "class").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_words"))


def lexicon_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.conflicts(*_lexicons(spark, sf_dir))


def near_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words with the number of Bulgarian words whose trigrams are similar."""
    return similar.near_conflicts(*_lexicons(spark, sf_dir))


def lookahead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(_docs(spark, sf_dir))
    return lookup.look_ahead(lookup.classify(words, *_lexicons(spark, sf_dir)), "doc_id")


def edit1_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of the transliterated words that neither lexicon has."""
    counted = _counted(spark, sf_dir)
    en, bg = _lexicons(spark, sf_dir, counted)
    unknown = lookup.classify_distinct(counted.select("word").distinct(), en, bg).filter("class = 'neither'").select(F.lower(mapping.to_cyrillic(F.col("word"))).alias("word")).distinct()
    return correct.edit1(unknown, bg)


def hyphen_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _blank_split(_docs(spark, sf_dir)).select("token").distinct()
    return words.select("token", tokens.map_token(F.col("token")).alias("mapped"), tokens.stem(F.col("token")).alias("stem"), tokens.trailing(F.col("token")).alias("tail"))


def sim_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.simulate(lookup.classify(_turns(spark, sf_dir), *_lexicons(spark, sf_dir)))


def app_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, counted = _words(_docs(spark, sf_dir)).drop("lang"), _counted(spark, sf_dir)
    each = fold.word_features(_by_word(counted), *_lexicons(spark, sf_dir, counted))
    return fold.detect(lookup.attach(words, each), "doc_id", last=scan.longest(counted, "last"))


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the words of conversations, by themselves and with the eight words before them."""
    return scores.with_phrase_scores(_turns(spark, sf_dir), _recogniser(_counted(spark, sf_dir)))


def spell_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest frequent English word for each word that neither lexicon has."""
    counted = _counted(spark, sf_dir)
    unknown = lookup.classify_distinct(_by_word(counted), *_lexicons(spark, sf_dir, counted)).filter("class = 'neither'")
    return speller.spell(unknown.select(F.lower("word").alias("word")), _frequent(counted))


def app_fold_assisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fold with language scores and the English speller."""
    words, counted = _words(_docs(spark, sf_dir)).drop("lang"), _counted(spark, sf_dir)
    each = fold.word_features(_by_word(counted), *_lexicons(spark, sf_dir, counted))
    each = stored(speller.correct_english(each, _frequent(counted), where="class = 'neither'"), "corrected")
    each = stored(scores.with_scores(each, _recogniser(counted)), "assisted")
    return fold.detect(lookup.attach(words, each), "doc_id", last=scan.longest(counted, "last"))


#: Seconds without an event that end a session, and that a stream waits for events out of order.
IDLE, DELAY = 4 * 3600, 3600
TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _written_times(rows: DataFrame, *names: str) -> DataFrame:
    """Times as text, which no session's time zone changes."""
    return rows.withColumns({c: F.date_format(c, TIME) for c in names})


def _preferences(events: DataFrame) -> DataFrame:
    """Stand-in for changes of the default language: those that sign-ups make, by their value."""
    label = F.when(F.floor("value") % 2 == 0, "BG").otherwise("EN")
    return events.filter("event_type = 'signup' and value is not null").select("user_id", F.col("ts").alias("since"), label.alias("preference"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of users, cut by inactivity."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _written_times(timeline.sessions(events, IDLE), "session_start", "session_end")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, which an event far ahead of all others ends."""
    base = shared_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg((F.max("ts") + F.expr(f"interval {IDLE + DELAY + 1} seconds")).alias("ts")).filter("ts is not null")
    events.union(last.select(F.lit(-(1 << 63)).cast("bigint"), "ts")).write.parquet(f"{base}/in")
    stream = timeline.cut_stream(spark.readStream.schema(events.schema).parquet(f"{base}/in"), IDLE, DELAY)
    return _written_times(detect.run_to_end(stream, f"{base}/out", f"{base}/checkpoint"), "session_start", "session_end")


def session_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of users with the default language that holds when they begin."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = timeline.as_of(timeline.sessions(events, IDLE), _preferences(events), "preference", at="session_start")
    return _written_times(found.select("user_id", "session_start", F.coalesce("preference", F.lit("EN")).alias("preference"), "n_events"), "session_start")


def keystroke_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn typed key by key; the text that reaches the application."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    session = F.concat_ws(":", F.col("conv_id"), F.col("turn"), F.col("role"))
    done = replay.replay(events.typed(turns, session), *_lexicons(spark, sf_dir), texts_only=True)
    return done.filter("emitted <> ''").select("session_id", "seq", "emitted")


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full fold over conversations as a stream; equals the batch fold."""
    base = shared_path(spark, "stream")
    rows = fold.features(_turns(spark, sf_dir), *_lexicons(spark, sf_dir)).select("session", "pos", "word", "in_en", "in_bg", "bg_fix")
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    return detect.run_to_end(detect.detect_stream(stream), f"{base}/out", f"{base}/checkpoint")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn typed key by key, as a stream of steps with the lexicons' answers (as stream_fold has its words'); equals keystroke_replay."""
    base = shared_path(spark, "stream")
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    session = F.concat_ws(":", F.col("conv_id"), F.col("turn"), F.col("role"))
    rows = replay.answered(events.typed(turns, session), *_lexicons(spark, sf_dir))
    rows.write.parquet(f"{base}/in")
    stream = detect.type_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    return detect.run_to_end(stream, f"{base}/out", f"{base}/checkpoint").filter("emitted <> ''").select("session_id", "seq", "emitted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        translit_tokens, token_kind_counts, segment_tokens, abbrev_expand, case_restore, lexicon_build, lexicon_scan, lexicon_class, lexicon_conflicts,
        lookahead_pairs, edit1_correct, hyphen_map, sim_fold, app_fold, keystroke_replay, stream_fold, stream_replay, language_scores, spell_english, app_fold_assisted,
        near_conflicts, event_sessions, stream_sessions, session_preferences,
    )
}
