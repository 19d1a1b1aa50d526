"""Column functions on tags, words, titles, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag roots that the tagger owns.
OWNED_ROOTS = ("Places/", "Landmarks/", "Objects/", "Scenes/")
# Fixed value: the form of an OCR word.
OCR_WORD = "^[a-zA-Z0-9À-ÿ][a-zA-Z0-9À-ÿ'.&@#%\\-]{0,30}$"
# Vowels, and the consonant groups with which words begin.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöùúûüÿ"
ONSETS = (
    "bl br ch cl cr dr dw fl fr gh gl gn gr kh kl kn kr ph pl pr qu sc sh sk sl sm sn sp sq st str sw th tr tw vl wh wr zh"
).split()
# Words that stay small inside an English title.
SMALL_WORDS = "a an and as at but by en for if in of on or the to v via vs".split()
# Image extensions that are passed over.
SKIPPED_EXTENSIONS = ".svg .ogg .ogv .webm .djvu .pdf .mid .flac .wav .tiff .tif".split()

# Image extensions of which no small picture is served.
NO_THUMBNAIL = (".tiff", ".tif", ".djvu")


def leaf(tag: Column) -> Column:
    """The last segment of a tag path."""
    return F.substring_index(tag, "/", -1)


def root(tag: Column) -> Column:
    return F.substring_index(tag, "/", 1)


def owned(tag: Column) -> Column:
    """Begins with one of the owned roots, in their case."""
    return F.coalesce(tag.rlike("^(" + "|".join(OWNED_ROOTS) + ")"), F.lit(False))


def piped(tag: Column) -> Column:
    return F.replace(tag, F.lit("/"), F.lit("|"))


def any_prefix(tags: Column, *prefixes: str) -> Column:
    return F.exists(tags, lambda t: F.coalesce(t.rlike("^(" + "|".join(prefixes) + ")"), F.lit(False)))


def distinct_in_order(tags: Column) -> Column:
    """First occurrences; null and empty elements go."""
    return F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != "")))


def union_in_order(*lists: Column) -> Column:
    """First occurrences over all lists in turn; a null list is empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def as_list(text: Column) -> Column:
    """A bare string as a list of one; null stays null."""
    return F.when(text.isNotNull(), F.array(text))


def leaves(tags: Column) -> Column:
    """Lower-case leaves, distinct."""
    return F.array_distinct(F.transform(tags, lambda t: F.lower(leaf(t))))


def new_by_leaf(tags: Column, existing_leaves: Column) -> Column:
    """Tags whose lower-case leaf is not among the existing ones."""
    return F.filter(tags, lambda t: ~F.array_contains(existing_leaves, F.lower(leaf(t))))


def people(tags: Column) -> Column:
    """Names below People/, distinct in order."""
    return F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith("People/")), leaf))


def plausible_word(word: Column) -> Column:
    """Has a vowel, begins with a vowel or a known group, and is at most half digits."""
    w = F.lower(word)
    a, b = F.substring(w, 1, 1), F.substring(w, 2, 1)
    group = (F.length(w) < 2) | a.rlike(f"[{VOWELS}]") | b.rlike(f"[{VOWELS}]")
    known = F.substring(w, 1, 3).isin(*ONSETS) | F.substring(w, 1, 2).isin(*ONSETS)
    digits = F.length(F.regexp_replace(w, "[^0-9]", ""))
    return w.rlike(f"[{VOWELS}]") & (group | known) & (digits * 2 <= F.length(w))


def good_word(word: Column) -> Column:
    return word.rlike(OCR_WORD) & plausible_word(word)


def good_words(text: Column) -> Column:
    """The plausible words of a text, in order; white space is Unicode's."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, "(?U)\\s+", " ")), " "), lambda w: (w != "") & good_word(w))


def title(text: Column) -> Column:
    """Words capitalised after spaces and hyphens, Roman numerals in capitals, small words small but for the first and
    last, d', l' and o' and what follows them capitalised. A text all in capitals is lowered first; else words with capitals inside stay as they are."""
    trimmed = F.trim(text)
    words = F.split(F.when((F.upper(trimmed) == trimmed) & (F.lower(trimmed) != trimmed), F.lower(trimmed)).otherwise(trimmed), " +")
    head = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000000))
    parts = lambda w: F.array_join(F.transform(F.split(w, "-"), head), "-")
    after = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1), F.upper(F.substring(w, 3, 1)), F.substring(w, 4, 1000000))

    def titled(words: Column) -> Column:
        def one(w: Column, k: Column) -> Column:
            inside = (k > 0) & (k < F.size(words) - 1)
            return (
                F.when(inside & F.lower(w).isin(*SMALL_WORDS), F.lower(w))
                .when(w.rlike("(?i)^(?=[ivxlc])c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), F.upper(w))
                .when(w.rlike("(?i)^[dol]['‘’][a-z]+$"), after(w))
                .when(w.rlike("[a-zA-Z][A-Z]"), w)
                .otherwise(parts(w))
            )

        return F.array_join(F.transform(words, one), " ")

    return F.get(F.transform(F.array(words), titled), F.lit(0))  # the words are found once


def extension(path: Column) -> Column:
    """The lower-case suffix with its dot, or the empty text."""
    return F.lower(F.regexp_extract(path, "[^/.][^/]*?(\\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)\\.[^.]+$", "")


def sidecar(path: Column) -> Column:
    return F.concat(path, F.lit(".xmp"))


def other_sidecar(path: Column) -> Column:
    """The suffix replaced by .xmp, or .xmp at the end where there is none; null where that is the path itself."""
    made = F.concat(F.regexp_replace(path, "(?<=[^/])\\.[^./]+$", ""), F.lit(".xmp"))
    return F.when(made != path, made)


def quoted(name: Column) -> Column:
    """Percent encoding that leaves / and ~ and encodes *, spaces as underscores."""
    x = F.url_encode(F.replace(name, F.lit(" "), F.lit("_")))
    for a, b in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def commons_url(name: Column) -> Column:
    """Where Commons serves a file of this name."""
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), quoted(name))


def cache_name(wikidata_id: Column, idx: Column, url: Column) -> Column:
    """The name under which a download is kept: id, place and suffix; kinds that are made small, or have none, as .jpg."""
    ext = extension(url_name(url))
    return F.concat(wikidata_id, F.lit("_"), idx.cast("string"), F.when(ext.isin("", *NO_THUMBNAIL), ".jpg").otherwise(ext))


def url_name(url: Column) -> Column:
    """The decoded last segment of a URL; plus signs stay."""
    last = F.substring_index(F.regexp_replace(url, "[?#].*$", ""), "/", -1)
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def grid(n: Column) -> Column:
    """Columns and rows of a contact sheet."""
    cols = F.least(n, F.ceil(F.sqrt(n.cast("double")))).cast("int")
    return F.struct(cols.alias("cols"), F.ceil(n / cols).cast("int").alias("rows"))


def overlaid(base: Column, overlay: Column) -> Column:
    """Settings by dotted keys (map<string,string>) with those of the overlay on top; null maps are empty. A setting of the
    overlay takes the place of all that stands below its key, and of a plain setting that it stands below."""
    none = F.create_map().cast("map<string,string>")
    base, overlay = F.coalesce(base, none), F.coalesce(overlay, none)
    keys = F.map_keys(overlay)
    hidden = lambda k: F.exists(keys, lambda o: (o == k) | F.startswith(k, F.concat(o, F.lit("."))) | F.startswith(o, F.concat(k, F.lit("."))))
    return F.map_concat(F.map_filter(base, lambda k, v: ~hidden(k)), overlay)
