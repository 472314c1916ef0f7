"""Relative references, percent signs and hosts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import let

#: Scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B).
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def without_dots(path: Column, whole: Column) -> Column:
    """A path with its . and .. segments carried out, from the root; unless it came whole, inner empty segments go."""

    def of(pieces: Column) -> Column:
        last = F.element_at(pieces, -1)
        inner = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 2)), lambda s: whole | (s != ""))
        every = F.concat(F.slice(pieces, 1, 1), inner, F.when(F.size(pieces) > 1, F.array(last)).otherwise(F.array().cast("array<string>")))
        up = lambda done: F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))
        folded = F.aggregate(every, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
        joined = F.array_join(F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/")
        return let(joined, lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))

    return let(F.split(path, "/"), of)


def resolve(base: Column, reference: Column) -> Column:
    """A reference made absolute against a page's address (http or https); null if either is null."""
    parts = lambda url: F.array(*[_part(url, i) for i in range(1, 6)])

    def of(both: Column) -> Column:
        own, page = [both["own"][i] for i in range(5)], [both["page"][i] for i in range(5)]
        scheme, host, path, query, fragment = own
        folder = F.regexp_replace(page[2], "[^/]*$", "")
        merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
        tail = lambda mark, text: F.when(text != "", F.concat(F.lit(mark), text)).otherwise("")
        whole = lambda h, p, q: F.concat(page[0], F.lit("://"), h, p, tail("?", q), tail("#", fragment))
        return (
            F.when((scheme != "") & (F.lower(scheme) != F.lower(page[0])), reference)
            .when(host != "", whole(host, path, query))
            .when(path == "", whole(page[1], page[2], F.when(query != "", query).otherwise(page[3])))
            .otherwise(whole(page[1], without_dots(merged, path.startswith("/")), query))
        )

    split = F.struct(parts(reference).alias("own"), parts(base).alias("page"))
    return F.when(base.isNull() | reference.isNull(), F.lit(None)).when(reference == "", base).otherwise(let(split, of))


def unquote(text: Column) -> Column:
    """Percent codes decoded as UTF-8; a plus sign and a percent sign without two digits stay."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)


def host(url: Column) -> Column:
    """The host in lower case, without a port; empty if there is none."""
    return F.lower(F.regexp_replace(_part(url, 2), ":[0-9]*$", ""))


def on_hosts(url: Column, names: list[str]) -> Column:
    """Whether the host is one of names or lies under one."""
    h = host(url)
    out = F.lit(False)
    for n in names:
        out = out | (h == n) | h.endswith(f".{n}")
    return out
