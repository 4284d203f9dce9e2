"""Text normalisation and scalar functions as columns.

Everything stays in the JVM but for compatibility composition (NFKC), full case folding and character names, which
no built-in function has: those run in an Arrow UDF that gets null for pure-ASCII rows.
"""

from __future__ import annotations

import base64
import codecs
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed_values as V

#: What counts as white space: also the four separators that only some regex dialects have.
WHITE = r"(?U)[\s\x1c-\x1f]"
ASCII_ONLY = r"^[\x00-\x7f]*$"


def bound(c: Column, f) -> Column:
    """f of a column that is computed once a row: the variable of a lambda, which no rule of the optimizer replaces by a copy of its expression."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WHITE}+$|^{WHITE[4:]}+", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def drop_zero_width(c: Column) -> Column:
    return F.translate(c, V.ZERO_WIDTH, "")


def whitespace(c: Column) -> Column:
    """No zero-width characters; runs of white space are one blank; none at the ends."""
    return F.trim(F.regexp_replace(drop_zero_width(c), f"{WHITE}+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(drop_zero_width(c), f"{WHITE}+", "")


def half_width(c: Column) -> Column:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(c, "　" + wide, " " + "".join(map(chr, range(0x21, 0x7F))))


def homoglyphs(c: Column, table: tuple[str, str] = V.HOMOGLYPHS) -> Column:
    return F.translate(c, *table)


def _unicode(kind: str, method: str, c: Column) -> Column:
    """A static function (text, true) of the Unicode library that ships with Spark, inside the JVM; null stays null."""
    return F.when(c.isNotNull(), F.call_function("reflect", F.lit(f"com.ibm.icu.{kind}"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(True)))


def casefold(c: Column) -> Column:
    """Full case folding."""
    return F.when(c.rlike(ASCII_ONLY), F.lower(c)).otherwise(_unicode("lang.UCharacter", "foldCase", c))


def nfkc(c: Column) -> Column:
    """Compatibility decomposition, then composition."""
    return F.when(c.rlike(ASCII_ONLY), c).otherwise(_unicode("text.Normalizer", "compose", c))


def unicode_chain(c: Column) -> Column:
    """NFKC, half width, no zero width, look-alikes replaced, case folded. Of ASCII texts only the letter case changes."""
    whole = homoglyphs(drop_zero_width(half_width(_unicode("text.Normalizer", "compose", c))))
    return F.when(c.rlike(ASCII_ONLY), F.lower(c)).otherwise(_unicode("lang.UCharacter", "foldCase", whole))


def strip_symbols(c: Column) -> Column:
    """Separators between letters, digits or ideographs go; runs of white space are one blank."""
    near = r"A-Za-z0-9一-鿿"
    x = F.regexp_replace(drop_zero_width(c), rf"(?<=[{near}])[-_./*\\]+(?=[{near}])", "")
    return F.trim(F.regexp_replace(x, f"{WHITE}+", " "))


def symbol_obfuscated(c: Column, stripped: Column) -> Column:
    return (c != stripped) & c.rlike(r"[-_./*\\]")


def spacing_obfuscated(c: Column) -> Column:
    x = whitespace(c)
    return x.rlike(r"(?U)(?:\b[a-zA-Z0-9]\b\s+){2,}\b[a-zA-Z0-9]\b") | x.rlike(r"(?U)(?:[一-鿿]\s+){2,}[一-鿿]")


def confusable(c: Column) -> Column:
    """Does it hold look-alike characters (after NFKC, half width and zero width)?"""
    return bound(drop_zero_width(half_width(nfkc(c))), lambda x: homoglyphs(x) != x)


def confusable_steps(c: Column) -> Column:
    """(from, to, reason) of every replaced character, in order."""
    table = dict(zip(*V.HOMOGLYPHS))
    names = {a: f"{unicodedata.name(a, a)} mapped to {unicodedata.name(b, b)}" for a, b in table.items()}
    reasons = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    x = drop_zero_width(half_width(nfkc(c)))
    chars = F.filter(F.split(x, ""), lambda ch: (ch != "") & (F.translate(ch, *V.HOMOGLYPHS) != ch))
    return F.transform(chars, lambda ch: F.struct(F.lit("unicode_confusable").alias("type"), ch.alias("from"), F.translate(ch, *V.HOMOGLYPHS).alias("to"), F.element_at(reasons, ch).alias("reason")))


def _readable(c: Column) -> Column:
    return (F.length(c) > 0) & ~c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]") & ~c.rlike(r"[\p{Cf}\p{Cs}\p{Co}\p{Cn}]")


def _utf8(b: Column) -> Column:
    return F.try_validate_utf8(b.cast("string"))


def decoded(c: Column) -> Column:
    """Struct of what the text decodes to: base64, url and hex; null where it doesn't, or not to readable text."""
    return bound(strip(c), lambda t: bound(F.regexp_replace(t, f"{WHITE}+", ""), lambda bare: _decoded(t, bare)))


def _decoded(t: Column, bare: Column) -> Column:
    as64 = F.when(t.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(t) % 4 == 0), _utf8(F.try_to_binary(t, F.lit("base64"))))
    url = F.when(t.rlike("[%+]"), _percent(t))
    hexed = F.when(bare.rlike("^[0-9A-Fa-f]+$") & (F.length(bare) % 2 == 0) & (F.length(bare) >= 4), _utf8(F.try_to_binary(bare, F.lit("hex"))))
    ok = lambda c: bound(c, lambda x: F.when(_readable(x), x))
    return F.struct(ok(as64).alias("base64"), bound(url, lambda x: F.when((x != t) & _readable(x), x)).alias("url"), ok(hexed).alias("hex"))


def _percent(t: Column) -> Column:
    """Percent and plus decoding; a broken escape stays as it is."""
    safe = F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe)


def alias_hits(c: Column, aliases: dict[str, list[str]] = V.ALIASES, folded: bool = False) -> Column:
    """(canonical, language) for each notion with an alias in the text, or in the text without blanks; its first alias decides the language."""
    return bound(c if folded else casefold(c), lambda x: bound(F.regexp_replace(x, f"{WHITE}+", ""), lambda packed: _alias_hits(x, packed, aliases)))


def _alias_hits(x: Column, packed: Column, aliases: dict[str, list[str]]) -> Column:
    hits = []
    for canonical, words in aliases.items():
        first = None
        for w in reversed(words):
            low = w.casefold()
            hit = x.contains(low) | packed.contains(re.sub(r"\s+", "", low))
            language = "zh" if re.search("[一-鿿]", w) else "en"
            first = F.when(hit, F.lit(language)) if first is None else F.when(hit, F.lit(language)).otherwise(first)
        hits.append(F.when(first.isNotNull(), F.struct(F.lit(canonical).alias("canonical"), first.alias("language"))))
    return F.array_compact(F.array(*hits))


def is_common_format(c: Column) -> Column:
    """Is there a text at all? False for null and empty ones."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def rebuild_hits(c: Column) -> Column:
    """(type, matched_text) for each family of requests to rebuild a secret, with its first match."""
    hits = [F.when(c.rlike("(?iU)" + p), F.struct(F.lit(name).alias("type"), F.regexp_extract(c, "(?iU)(" + p + ")", 1).alias("matched_text"))) for name, p in V.REBUILD_PATTERNS.items()]
    return F.array_compact(F.array(*hits))


def normalise(c: Column) -> Column:
    """Struct of all normal forms and of the sorted suspicion flags. Each form is bound, as the later ones name it many times: without that, the plan holds
    hundreds of copies of the first."""
    nest = lambda raw, normal: bound(strip_symbols(normal), lambda bare: bound(decoded(raw), lambda codes: bound(alias_hits(normal, folded=True), lambda aliases: bound(rebuild_hits(raw), lambda rebuilt: _normal_forms(raw, normal, bare, codes, aliases, rebuilt)))))
    return bound(c, lambda raw: bound(whitespace(raw), lambda spaced: bound(unicode_chain(spaced), lambda normal: nest(raw, normal))))


def _normal_forms(c: Column, normal: Column, bare: Column, codes: Column, aliases: Column, rebuilt: Column) -> Column:
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = F.array_compact(F.array(
        flag(confusable(c), "unicode_confusable_detected"),
        flag(drop_zero_width(c) != c, "zero_width_character_removed"),
        flag(spacing_obfuscated(c), "spacing_obfuscation_detected"),
        flag(symbol_obfuscated(normal, bare), "symbol_obfuscation_detected"),
        flag(codes["base64"].isNotNull(), "possible_base64_detected"),
        flag(codes["url"].isNotNull(), "possible_url_encoding_detected"),
        flag(codes["hex"].isNotNull(), "possible_hex_detected"),
        flag(F.size(aliases) > 0, "cross_language_alias_detected"),
        flag(F.size(rebuilt) > 0, "reconstruction_pattern_detected"),
    ))
    return F.struct(
        c.alias("raw_text"),
        normal.alias("normalized_text"),
        normal.alias("casefold_text"),
        compact(normal).alias("compact_text"),
        bare.alias("symbol_stripped_text"),
        F.array_distinct(F.array_compact(F.array(codes["base64"], codes["url"], codes["hex"]))).alias("decoded_candidates"),
        F.array_sort(F.array_distinct(F.transform(aliases, lambda a: a["language"]))).alias("detected_languages"),
        F.array_sort(F.transform(aliases, lambda a: a["canonical"])).alias("matched_aliases"),
        F.array_sort(flags).alias("suspicion_flags"),
        rebuilt.alias("reconstruction"),
    )


def asset_text(c: Column) -> Column:
    """Normal form of an asset's texts."""
    return strip(homoglyphs(nfkc(F.translate(c, V.ASSET_ZERO_WIDTH, "")), V.ASSET_HOMOGLYPHS))


def unescaped(c: Column) -> Column:
    """Readings of a text with \\uXXXX escapes: with them decoded in place, and, from two on, of them alone."""
    pattern = r"\\u([0-9a-fA-F]{4})"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    char = lambda h: F.decode(F.unhex(h), "UTF-16BE")
    pieces = F.split(c, pattern, -1)
    inside = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(found)), F.transform(found, char), lambda p, h: F.concat(p, h)), ""), F.element_at(pieces, -1))
    alone = F.array_join(F.transform(F.filter(found, lambda h: F.conv(h, 16, 10).cast("int") >= 32), char), "")
    return F.when(F.size(found) > 0, F.array_compact(F.array(inside, F.when((F.size(found) >= 2) & (alone != ""), alone)))).otherwise(F.array().cast("array<string>"))


# ---- small functions ----------------------------------------------------------------------------------

ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT_TO = codecs.encode(ROT_FROM, "rot13")


def to_base64(c: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n]", "")


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def rot13(c: Column) -> Column:
    return F.translate(c, ROT_FROM, ROT_TO)


def _kept(ch: Column) -> Column:
    return ch.rlike(r"^[\p{L}\p{N}._~-]$")


def percent_code(c: Column) -> Column:
    """%XX with the character's code point, not its bytes; letters, digits and ._-~ stay."""
    code = lambda ch: F.hex(F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("long"))
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.when(_kept(ch), ch).otherwise(F.concat(F.lit("%"), F.lpad(code(ch), F.greatest(F.lit(2), F.length(code(ch))), F.lit("0"))))), "")


def unicode_code(c: Column) -> Column:
    """\\uXXXX of every character."""
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.concat(F.lit("\\u"), F.lower(F.right(F.hex(F.encode(ch, "UTF-32")), F.lit(4))))), "")


def grams(c: Column, n: int = 4) -> Column:
    """Distinct substrings of n characters, in order."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: c.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def plain_grams(c: Column, n: int = 4) -> Column:
    """The same without those that hold punctuation."""
    return F.filter(grams(c, n), lambda g: ~g.rlike(r"[{}_\- .,!?:;]"))


def stream_fragments(c: Column) -> Column:
    """Lower-cased substrings of 8 characters, and of 7 with one that is neither letter nor digit: those from which every longer one follows."""
    low = F.lower(c)
    return F.array_union(grams(low, 8), F.filter(grams(low, 7), lambda g: g.rlike(r"[^\p{L}\p{N}]")))


def parts(c: Column, least: int = 6) -> Column:
    """Distinct parts between brackets, then between any delimiters, of at least so many characters."""
    cut = lambda p: F.transform(F.split(c, p, -1), strip)
    both = F.concat(cut(r"[{}()\[\]]+"), cut(r"(?U)[{}\[\]()_\-.\s,;:!?]+"))
    return F.array_distinct(F.filter(both, lambda x: F.length(x) >= least))


def alnum_only(c: Column) -> Column:
    return F.lower(F.regexp_replace(nfkc(c), "[^a-zA-Z0-9]", ""))


def literal_base64(value: str) -> str:
    return base64.b64encode(value.encode()).decode()
