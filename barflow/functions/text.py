"""Text, token and timestamp parsing helpers for news, logs and feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: headline lexicon
NEGATIVE_WORDS = [
    "ban", "banned", "crash", "drop", "plunge", "hack", "hacked", "exploit", "scam", "fraud", "rug", "rugpull",
    "bear", "bearish", "lawsuit", "investigation", "indicted", "arrested", "down", "loss", "warning", "fail",
    "fails", "failed", "collapsed", "collapse", "selloff", "dump", "fud", "regulation", "regulator", "fine",
    "fined", "delist", "delisted",
]
POSITIVE_WORDS = [
    "surge", "surges", "rally", "rallies", "soar", "soars", "bull", "bullish", "breakout", "ath", "all-time",
    "approved", "approval", "etf", "adoption", "partnership", "launch", "launched", "milestone", "growth",
    "rises", "rise", "gains", "gain", "up", "high", "record", "boost", "boosts",
]
# fixed values: keywords counted as substrings
BULL_KEYWORDS = [
    "buy", "bull", "pump", "moon", "breakout", "rally", "surge", "long", "gain", "rise", "recover", "support",
    "bullish", "ath", "upside",
]
BEAR_KEYWORDS = [
    "sell", "bear", "crash", "dump", "short", "drop", "fall", "decline", "fear", "loss", "breakdown", "risk",
    "bearish", "correction", "downside",
]
# fixed values: channel-message keywords (English and Russian)
CHANNEL_BULL = ["buy", "long", "pump", "bull", "moon", "up", "strong buy", "лонг", "покупка", "бычий", "рост"]
CHANNEL_BEAR = ["sell", "short", "dump", "bear", "crash", "down", "strong sell", "шорт", "продажа", "медвежий", "падение"]
# fixed values: extra headline keywords per coin (the lower-cased coin itself always counts)
COIN_KEYWORDS = {
    "BTC": ["bitcoin"],
    "ETH": ["ethereum", "ether"],
    "SOL": ["solana"],
    "ADA": ["cardano"],
    "BNB": ["binance coin", "bnb chain"],
    "XRP": ["ripple"],
    "DOGE": ["dogecoin"],
    "TRX": ["tron"],
    "AVAX": ["avalanche"],
    "SHIB": ["shiba inu"],
    "DOT": ["polkadot"],
    "LINK": ["chainlink"],
    "NEAR": ["near protocol"],
    "UNI": ["uniswap"],
    "LTC": ["litecoin"],
    "APT": ["aptos"],
    "ATOM": ["cosmos"],
    "HBAR": ["hedera"],
    "ICP": ["internet computer"],
    "SUI": ["sui network", "sui blockchain"],
}
# fixed values: volatile log tokens and their placeholders, applied in this order
LOG_TOKENS = [
    (r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2},?\d*\b", "<TS>"),
    (r"\b\d{2}:\d{2}:\d{2},\d+\b", "<TS>"),
    (r"\b[A-Z]{2,5}_USDT\b", "<SYM>"),
    (r"\b[A-Z]{2,5}/USDT(?::USDT)?\b", "<SYM>"),
    (r"\bPID\s+\d+\b", "<PID>"),
    (r"https?://\S+", "<URL>"),
    (r"-?\d+\.\d+e[+-]\d+", "<NUM>"),
    (r"-?\d+\.\d+", "<NUM>"),
    (r"\b\d{4,}\b", "<NUM>"),
    (r"\s+", " "),
]
STRIP_CHARS = ".,!?:;'\"()"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Distinct lower-cased words with surrounding punctuation removed."""
    parts = F.split(F.trim(_c(text)), r"\s+")
    return F.array_distinct(F.transform(parts, lambda w: F.lower(F.btrim(w, F.lit(STRIP_CHARS)))))


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lexicon_tone(text: str | Column) -> Column:
    """(positive - negative) / (positive + negative) distinct lexicon words, 3 digits; 0 without any."""
    w = words(text)
    p = F.size(F.array_intersect(w, _literals(POSITIVE_WORDS)))
    n = F.size(F.array_intersect(w, _literals(NEGATIVE_WORDS)))
    return F.when(_c(text).isNull() | (p + n == 0), 0.0).otherwise(F.round((p - n) / F.greatest(p + n, F.lit(1)), 3))


def _hits(text: Column, keywords: Sequence[str]) -> Column:
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(text, F.lit(k)).cast("int")
    return total


def keyword_tone(text: str | Column) -> Column:
    """Balance of bullish and bearish substrings in [-1, 1]."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    b, s = _hits(low, BULL_KEYWORDS), _hits(low, BEAR_KEYWORDS)
    return F.when(b + s > 0, (b - s).cast("double") / (b + s)).otherwise(0.0)


def contains_any(text: str | Column, keywords: Sequence[str]) -> Column:
    """True if any keyword occurs as a substring of the lower-cased text."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(low, F.lit(k))
    return hit


def channel_signal(text: str | Column) -> Column:
    """+1 if a bullish keyword occurs, else -1 if a bearish one does, else 0."""
    return F.when(contains_any(text, CHANNEL_BULL), 1.0).when(contains_any(text, CHANNEL_BEAR), -1.0).otherwise(0.0)


def label_tone(label: str | Column, confidence: str | Column) -> Column:
    """Signed confidence of a classifier label (bullish / positive against bearish / negative)."""
    low = F.lower(F.coalesce(_c(label), F.lit("")))
    has = lambda *ks: contains_any(low, ks)
    conf = F.round(_c(confidence).cast("double"), 3)
    return F.when(has("bull", "pos", "label_2"), conf).when(has("bear", "neg", "label_0"), -conf).otherwise(0.0)


def category_match(text: Column, categories: str) -> Column:
    """Any of a comma-separated list of terms occurs; an empty list matches everything."""
    terms = [t.strip().lower() for t in categories.split(",") if t.strip()]
    return contains_any(text, terms) if terms else F.lit(True)


def coin_tags(title: str | Column, keywords: dict[str, Sequence[str]] | None = None) -> Column:
    """Array of coins whose keywords occur in the title (substring match), plus ALL."""
    low = F.lower(F.coalesce(_c(title), F.lit("")))
    tags = [F.lit("ALL")]
    for coin, extra in (keywords or COIN_KEYWORDS).items():
        tags.append(F.when(contains_any(low, [coin.lower(), *extra]), F.lit(coin)))
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


def log_signature(line: str | Column) -> Column:
    """Whole log line with volatile tokens replaced."""
    s = F.trim(_c(line))
    for pattern, token in LOG_TOKENS:
        s = F.regexp_replace(s, pattern, token)
    return s


def squeeze_spaces(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"\s+", " "))


def safe_symbol(raw: str | Column) -> Column:
    """Upper-case path-safe symbol; null unless it is made of A-Z 0-9 _ . - only."""
    s = F.upper(F.regexp_replace(F.trim(_c(raw)), r"[/ ,]", "_"))
    return F.when(s.rlike(r"^[A-Z0-9_.\-]+$"), s)


def coin_token(symbol: str | Column) -> Column:
    """Base asset of a pair symbol."""
    s = F.upper(F.regexp_replace(_c(symbol), "/", "_"))
    return F.split_part(s, F.lit("_"), F.lit(1))


def epoch_to_timestamp(x: str | Column) -> Column:
    """Seconds below 1e12, milliseconds below 1e15, nanoseconds above (whole numbers stay exact)."""
    x = _c(x)
    whole = F.call_function("div", x.try_cast("bigint"), F.lit(1000))
    return F.when(x < 1e12, F.timestamp_micros((x * 1e6).cast("bigint"))).when(
        x < 1e15, F.timestamp_micros((x * 1e3).cast("bigint"))
    ).otherwise(F.timestamp_micros(whole))


def text_to_timestamp(x: str | Column) -> Column:
    """Numbers by magnitude, ISO strings (naive means UTC) otherwise; null if neither parses."""
    x = _c(x).cast("string")
    number = x.try_cast("double")
    return F.when(number.isNotNull(), epoch_to_timestamp(number)).otherwise(F.try_to_timestamp(x))


def first_present(df: DataFrame, candidates: Sequence[str], kind: str = "string") -> Column:
    """First non-null of the candidate columns that this frame has; null if it has none."""
    found = [F.col(c).try_cast(kind) for c in candidates if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def backfill_columns(df: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Fill standard columns row by row from alternative names, e.g. {"title": ["headline", "name"]}."""
    for name, alts in wanted.items():
        own = F.when(F.trim(F.col(name)) != "", F.col(name)) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(own, first_present(df, alts), F.lit("")))
    return df


def clean_news(
    df: DataFrame, source: str, title: Column, url: Column, ts: Column, language: Column, domain: Column,
    coin: Column, tone: Column,
) -> DataFrame:
    """Raw feed rows in the news schema; rows without title, url or time are dropped.

    Texts are kept whole: a cut URL would make different articles equal.
    """
    return (
        df.select(
            ts.alias("ts"), squeeze_spaces(title).alias("title"),
            F.coalesce(url, F.lit("")).alias("url"), F.lit(source).alias("source"),
            F.coalesce(language, F.lit("")).alias("language"), tone.alias("tone"),
            coin.alias("coin"), F.coalesce(domain, F.lit("")).alias("domain"),
        )
        .where((F.col("title") != "") & (F.col("url") != "") & F.col("ts").isNotNull())
    )
