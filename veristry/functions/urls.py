"""URLs and e-mail domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers whose domain says nothing about an organisation.
GENERIC_MAIL = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com",
    "icloud.com", "live.com", "msn.com", "comcast.net", "att.net",
    "charter.net", "cox.net", "earthlink.net", "sbcglobal.net",
    "verizon.net", "bellsouth.net", "windstream.net", "centurytel.net",
    "suddenlink.net", "frontier.com", "twc.com", "cableone.net",
    "mac.com", "me.com", "protonmail.com", "proton.me", "zoho.com",
]

# Prefixes of mail servers, and words that raise a link's priority.
MAIL_PREFIXES = ["mail.", "email.", "smtp.", "mx.", "exchange.", "owa.", "webmail.", "outlook."]
PRIORITY_WORDS = ["portrait", "graduate", "strategic", "plan", "vision", "mission", "about", "district", "superintendent", "board", "leadership"]


def normalise_url(url: Column) -> Column:
    """Trimmed, with https:// where a scheme is missing; null for blanks, 'n/a', 'none', and what has no dot in its host."""
    u = F.trim(url)
    u = F.when(F.lower(u).isin("", "n/a", "na", "none", "null", "-"), F.lit(None)).otherwise(u)
    u = F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(host(u).contains("."), u)


def host(url: Column) -> Column:
    """The host in lower case, or null."""
    h = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(h != "", h)


def domain(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def mail_domain(mail: Column) -> Column:
    """Lower-case domain of an e-mail address; null for none and for generic providers."""
    d = F.trim(F.lower(F.split_part(mail, F.lit("@"), F.lit(2))))
    return F.when(mail.contains("@") & (F.length(d) >= 4) & ~d.isin(GENERIC_MAIL), d)


def mail_sites(mail: Column) -> Column:
    """Array of likely web sites: the domain without a mail server's prefix, then as it is, each also with www."""
    d = mail_domain(mail)
    base = d
    for p in reversed(MAIL_PREFIXES):
        base = F.when(d.startswith(p), F.substring(d, len(p) + 1, 1000)).otherwise(base)
    sites = lambda x: F.array(F.concat(F.lit("https://"), x), F.concat(F.lit("https://www."), x))
    return F.when(d.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(sites(base), sites(d))))


def variants(url: Column) -> Column:
    """Array of the four forms with and without www, under https and http."""
    d = domain(url)
    path = F.regexp_extract(url, r"^(?i)https?://[^/?#]+(.*)$", 1)
    return F.array(*[F.concat(F.lit(s), F.lit(w), d, path) for s in ("https://", "http://") for w in ("", "www.")])


def repairs(url: Column) -> Column:
    """Array of repaired forms of a URL with an obvious error; empty if there is none to see."""
    u = F.trim(url)
    h = host(F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))
    bare = F.regexp_replace(h, r"^(mail|email)\.", "")
    mail = h.rlike(r"^(mail|email)\.")
    short = h.rlike("^[a-z0-9-]+$")
    site = lambda prefix, x, end="": F.concat(F.lit(f"https://{prefix}"), x, F.lit(end))
    found = F.array(
        F.when(u.rlike(r"(?i)^https?://ww\."), F.regexp_replace(u, r"^(?i)(https?://)ww\.", "$1www.")),
        F.when(u.contains("www.www."), F.regexp_replace(u, r"www\.www\.", "www.")),
        *[F.when(mail, site(p, bare)) for p in ("", "www.")],
        *[F.when(short, site(p, h, e)) for p in ("", "www.") for e in (".org", ".com")],
    )
    state_only = F.coalesce(F.regexp_replace(h, r"^www\.", "").rlike(r"^k12\.[a-z]{2}\.us$"), F.lit(False))
    none = F.array().cast("array<string>")
    return F.when(state_only | url.isNull(), none).otherwise(F.filter(F.array_distinct(F.array_compact(found)), lambda x: x != url))


# Words that a district's name loses before it is tried as a host, in this order.
NAME_WORDS = ["school district", "unified", "independent", "public schools", "county", "city", "regional", "consolidated", "area", "parish", "township", "borough", "community", "central", "joint"]

# Forms of candidate hosts, with {j} the name joined, {h} hyphenated, {f} its first word and {s} the state.
CANDIDATES = [
    "https://www.{j}.k12.{s}.us", "https://{j}.k12.{s}.us", "https://www.{h}.k12.{s}.us",
    "https://www.{j}schools.org", "https://www.{j}schools.com", "https://{j}schools.org", "https://www.{j}schools.net",
    "https://www.{j}.org", "https://www.{j}.com", "https://www.{j}.net", "https://www.{j}.us",
    "https://www.{j}sd.org", "https://{j}sd.org", "https://www.{j}ps.org",
]
STATE_CANDIDATES = {
    "TX": ["https://www.{j}isd.org", "https://www.{j}isd.net", "https://www.{j}isd.com"],
    "GA": ["https://www.{j}county.schoolinsites.com", "https://www.{j}.schoolinsites.com"],
    **{state: ["https://www.{j}boe.org"] for state in ("NY", "NJ", "CT", "MA", "PA")},
}
LAST_CANDIDATES = ["https://www.{j}district.org"]
FIRST_WORD_CANDIDATES = ["https://www.{f}schools.org", "https://www.{f}.k12.{s}.us", "https://{f}.k12.{s}.us"]


def candidate_urls(name: Column, state: Column) -> Column:
    """Array of web sites that an organisation of this name and state code may have, likelier ones first, each once.

    The name is tried without its common words, joined, and for one form
    hyphenated; its first word alone where it has four letters at least and is
    not all of the name.  Empty for a null or empty name or state, and for a
    name of common words only.
    """
    base = F.lower(name)
    for word in NAME_WORDS:
        base = F.replace(base, F.lit(word), F.lit(""))
    base = F.trim(F.regexp_replace(F.regexp_replace(base, "schools$", ""), r"[^a-z0-9\s]", ""))
    base = F.regexp_replace(base, r"^\s+|\s+$", "")
    none = F.array().cast("array<string>")

    def parts(b: Column) -> Column:
        first = F.split_part(F.regexp_replace(b, r"\s+", " "), F.lit(" "), F.lit(1))
        return F.struct(F.regexp_replace(b, r"\s+", "").alias("j"), F.regexp_replace(b, r"\s+", "-").alias("h"), first.alias("f"), F.lower(state).alias("s"), state.alias("state"))

    def forms(x: Column) -> Column:
        def filled(form: str) -> Column:
            out = F.lit(form)
            for mark in ("j", "h", "f", "s"):
                out = F.replace(out, F.lit(f"{{{mark}}}"), x[mark]) if f"{{{mark}}}" in form else out
            return out

        found = [filled(c) for c in CANDIDATES]
        found += [F.when(x["state"] == s, filled(c)) for s, own in STATE_CANDIDATES.items() for c in own]
        found += [filled(c) for c in LAST_CANDIDATES]
        found += [F.when((F.length(x["f"]) >= 4) & (x["f"] != x["j"]), filled(c)) for c in FIRST_WORD_CANDIDATES]
        return F.when((x["j"] == "") | (x["state"] == "") | x["j"].isNull() | x["state"].isNull(), none).otherwise(F.array_distinct(F.array_compact(F.array(*found))))

    # arrays of one, so that the name is cut up once for a row and not once for each form
    return F.transform(F.transform(F.array(base), parts), forms)[0]


def link_priority(url: Column) -> Column:
    """One for each priority word in the URL, and one for a path of at most two steps."""
    u = F.lower(url)
    words = sum((F.when(u.contains(w), 1).otherwise(0) for w in PRIORITY_WORDS), F.lit(0))
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
    return (words + F.when(slashes - 2 <= 2, 1).otherwise(0)).cast("int")
