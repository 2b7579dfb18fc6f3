"""Column functions over text: repository urls, secrets in urls, paragraphs, dates, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner_repo(url: Column) -> Column:
    """struct<owner, repo, form> of a repository url in ssh-443, https or scp form, without .git; null if it is none."""
    forms = [
        ("ssh443", r"^ssh://[^/]*@ssh\.[^/:]+:443/([^/]+)/([^/]+?)(?:\.git)?/?$"),
        ("https", r"^https?://(?:[^/@]*@)?[^/]+/([^/]+)/([^/?#]+?)(?:\.git)?/?$"),
        ("scp", r"^[^/@]+@[^/:]+:([^/]+)/([^/]+?)(?:\.git)?/?$"),
    ]
    out = None
    for form, pattern in forms:
        found = F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo"), F.lit(form).alias("form"))
        out = F.when(url.rlike(pattern), found) if out is None else out.when(url.rlike(pattern), found)
    return out


def host(url: Column) -> Column:
    """Host name, lower-cased, without user, port and brackets; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"[\[\]]", "")), F.lit(""))


def is_loopback(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), r"^::ffff:", "")
    return bare.isin("localhost", "::1") | bare.rlike(r"^127(\.\d{1,3}){3}$")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def masked_query(url: Column, secret: str = r"(?i)(token|key|secret|password|auth|source)") -> Column:
    """The url with *** for the value of every query key that looks secret, and for userinfo."""
    parts = F.transform(F.split(query_of(url), "&"), lambda p: F.when(F.substring_index(p, "=", 1).rlike(secret) & F.contains(p, F.lit("=")), F.concat(F.substring_index(p, "=", 1), F.lit("=***"))).otherwise(p))
    lead, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)?$", 1)
    whole = F.when(query_of(url) == "", url).otherwise(F.concat(lead, F.lit("?"), F.array_join(parts, "&"), tail))
    return F.regexp_replace(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]+@", "$1***@")


def first_paragraph(text: Column) -> Column:
    """First line of the first paragraph that isn't blank."""
    paragraphs = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(F.translate(p, "\n\t", "  ")) != "")
    lines = F.filter(F.split(F.get(paragraphs, F.lit(0)), "\n"), lambda s: F.trim(s) != "")
    return F.trim(F.get(lines, F.lit(0)))


def table_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def git_date(iso: Column) -> Column:
    """"<epoch> ±HHMM": the wall clock read as if it were UTC, and the offset; 0 +0000 where it isn't a date."""
    clock = F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    offset = F.regexp_extract(iso, r"([+-]\d{2}):?(\d{2})$", 0)
    epoch = F.unix_seconds(F.to_timestamp(F.concat(F.replace(clock, F.lit("T"), F.lit(" ")), F.lit("Z")), "yyyy-MM-dd HH:mm:ssX"))
    zone = F.when(offset == "", "+0000").otherwise(F.replace(offset, F.lit(":"), F.lit("")))
    return F.when(clock == "", "0 +0000").otherwise(F.concat_ws(" ", epoch.cast("string"), zone))


def version(text: Column) -> Column:
    """struct<major, minor, patch> of the first version in a text; null without one."""
    pattern = r"(\d+)\.(\d+)\.(\d+)"
    part = lambda i: F.try_to_number(F.regexp_extract(text, pattern, i), F.lit("999999999")).cast("int")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def last_line(text: Column) -> Column:
    return F.element_at(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), -1)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def blob_sha1(content: Column) -> Column:
    """The object name of a blob: sha1 of its header and bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "utf-8"), F.lit(b"\x00"), raw))


def fingerprint(content: Column) -> Column:
    return F.left(F.sha2(content.cast("binary"), 256), F.lit(16))


def camel(flag: Column) -> Column:
    """kebab-case to camelCase."""
    words = F.split(flag, "-")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    return F.concat(F.get(words, F.lit(0)), F.array_join(rest, ""))


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([A-Z])", "-$1"))


def noreply(account_id: Column, login: Column, domain: str) -> Column:
    return F.when(account_id > 0, F.concat(account_id.cast("string"), F.lit("+"), login, F.lit("@" + domain))).otherwise(F.concat(login, F.lit("@" + domain)))


def is_ipv4(text: Column) -> Column:
    octets = F.split(text, r"\.")
    return text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: F.coalesce(F.try_to_number(o, F.lit("999")), F.lit(999)) <= 255)


def commit_title(kind: Column, scope: Column, what: Column) -> Column:
    """type(scope): what, as far as they are given."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(kind), what).otherwise(F.concat(F.trim(kind), F.when(blank(scope), "").otherwise(F.concat(F.lit("("), F.trim(scope), F.lit(")"))), F.lit(": "), what))


def built_urls(owner: Column, repo: Column, host_name: str) -> Column:
    """struct<ssh443, https, raw> of a repository's urls at a host."""
    name = F.concat(owner, F.lit("/"), repo)
    return F.struct(F.concat(F.lit(f"ssh://git@ssh.{host_name}:443/"), name, F.lit(".git")).alias("ssh443"), F.concat(F.lit(f"https://{host_name}/"), name, F.lit(".git")).alias("https"), F.concat(F.lit(f"https://raw.{host_name}/"), name).alias("raw"))


def clone_command(owner: Column, repo: Column, private: Column) -> Column:
    return F.concat(F.lit("clone "), owner, F.lit("/"), repo, F.when(private, " (private)").otherwise(""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes blanks alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
