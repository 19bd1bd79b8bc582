"""Column functions over URLs, identifiers, sizes and shell text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOOLS = ("wget", "axel", "aria2c", "aws_s3_cp")


def _last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shell_quote(text: Column) -> Column:
    """Quote for a shell where needed: safe texts stay as they are."""
    return F.when(text == "", "''").when(text.rlike("[^A-Za-z0-9_@%+=:,./-]"), shell_quote_always(text)).otherwise(text)


def shell_quote_always(text: Column) -> Column:
    """Single-quote for a shell, whatever the text."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def s3_url(url: Column) -> Column:
    """The s3:// form of an S3 URL or of a virtual-hosted https URL; null for others."""
    host = r"^https?://([^/?#]*)\.s3\.amazonaws\.com"
    rewritten = F.concat(F.lit("s3://"), F.regexp_extract(url, host, 1), F.regexp_extract(url, host + r"(/[^?#;]*)?", 2))
    return F.when(url.startswith("s3://"), url).when(url.rlike(host + r"([/?#]|\z)"), rewritten)


def url_path(url: Column) -> Column:
    """The path of a URL without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_basename(url: Column) -> Column:
    return _last_part(F.regexp_replace(url_path(url), r"/+\z", ""))


def file_name(filename: Column, url: Column) -> Column:
    """The file name, or the base name of the URL's path where there is none."""
    return F.coalesce(F.nullif(filename, F.lit("")), url_basename(url))


def download_command(tool: str, filename: Column, url: Column) -> Column:
    """One shell command to fetch a URL with a tool; null where the tool can't."""
    name, link = shell_quote(file_name(filename, url)), shell_quote(url)
    # The command lines of each tool.
    if tool == "wget":
        return F.concat(F.lit("wget -c -O "), name, F.lit(" "), link)
    if tool == "axel":
        return F.concat(F.lit("axel -a -n 10 -o "), name, F.lit(" "), link)
    if tool == "aria2c":
        return F.concat(F.lit("aria2c -c -x 8 -j 8 -s 8 -o "), name, F.lit(" "), link)
    if tool == "aws_s3_cp":
        s3 = s3_url(url)
        return F.concat(F.lit("[[ -f ./"), shell_quote(url_basename(s3)), F.lit(" ]] || aws s3 cp --no-sign-request "), shell_quote(s3), F.lit(" ./"))
    raise ValueError(f"unsupported download tool: {tool}")


def record_download_command(tool: str, name: Column, url: Column) -> Column:
    """One shell command for a record's file; names are always quoted."""
    # The command lines of each tool.
    heads = {"axel": "axel --insecure -c -n 20 -o ", "wget": "wget -c --content-disposition -O ", "aria2c": "aria2c -c -j 16 -x 16 -s 1 --out="}
    if tool not in heads:
        raise ValueError(f"unsupported download tool: {tool}")
    return F.concat(F.lit(heads[tool]), shell_quote_always(name), F.lit(" "), shell_quote_always(url))


def archive_download_command(tool: str, root: Column, path: Column) -> Column:
    """One shell command for a path under an archive's root URL."""
    # The command lines of each tool.
    if tool == "aspera":
        name = _last_part(path)
        head = F.concat(F.lit("[[ -f ./"), name, F.lit(" ]] && echo Skip: "), name, F.lit(" || ascp -vQT -l 500m -P33001 -k 1 -i ~/.aspera/connect/etc/aspera01.openssh aspera01@"))
        return F.concat(head, aspera_root(root), F.lit("/"), path, F.lit(" ./"))
    heads = {"axel": "axel --no-clobber -n 20 ", "aria2c": "aria2c -c -j 16 -x 16 -s 16 "}
    if tool not in heads:
        raise ValueError(f"unsupported download tool: {tool}")
    return F.concat(F.lit(heads[tool]), root, F.lit("/"), path)


def aspera_root(url: Column) -> Column:
    """An https root as host:path: no scheme, the first .ac.cn/ turned into .ac.cn: ."""
    bare = F.regexp_replace(F.regexp_replace(url, r"/+\z", ""), "^https://", "")
    return F.regexp_replace(bare, r"^(.*?)\.ac\.cn/", r"$1.ac.cn:")


def record_id(record: Column) -> Column:
    """The numeric record id in an id, a record URL or a DOI; null where there is none."""
    r = F.regexp_replace(F.trim(record), r"(?i)^doi:\s*", "")
    got = [F.regexp_extract(r, p, 1) for p in (r"^(\d+)\z", r"/records/(\d+)", r"(?i)10\.5281/zenodo\.(\d+)")]
    return F.coalesce(*[F.nullif(g, F.lit("")) for g in got])


def human_size(size: Column) -> Column:
    """Bytes as a number and a unit of 1024 steps, two decimals (none for bytes); ties round to even."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]

    def text(power: int) -> Column:
        # Hundredths in whole numbers: floor(size * 100 / 1024^p), then ties to even.
        unit = 1024**power
        scaled = size.cast("decimal(30,0)") * 100
        low = F.floor(scaled / F.lit(unit).cast("decimal(20,0)")).cast("long")
        rest = (scaled - low.cast("decimal(30,0)") * F.lit(unit).cast("decimal(20,0)")) * 2
        up = (rest > unit) | ((rest == unit) & (low % 2 == 1))
        cents = low + up.cast("long")
        return F.concat((cents / 100).cast("decimal(30,2)").cast("string"), F.lit(f" {units[power]}"))

    out = F.concat(size.cast("string"), F.lit(" B"))
    ladder = F.when(size < 1024, out)
    for p in range(1, 4):
        ladder = ladder.when(size < 1024 ** (p + 1), text(p))
    return ladder.otherwise(text(4))


def md5_of(checksum: Column) -> Column:
    """The hex digits behind md5:, or an empty text."""
    return F.when(checksum.startswith("md5:"), F.substring(checksum, 5, 1 << 20)).otherwise("")


def project_name(project: Column) -> Column:
    """The last part of a project id or URL, without trailing slashes."""
    return _last_part(F.regexp_replace(project, r"/+\z", ""))


def project_kind(project: Column) -> Column:
    """open, human, url or unsupported: how a project's files are found."""
    return F.when(project.rlike(r"^CRA[0-9]{6}\z"), "open").when(project.rlike(r"^HRA[0-9]{6}\z"), "human").when(project.startswith("http"), "url").otherwise("unsupported")


def looks_like_project(project: Column) -> Column:
    """The loose check before dispatch: starts with HRA, CRA or http."""
    return project.rlike("^([HC]RA|http)")


def download_root(project: Column) -> Column:
    """The root URL that follows from a project alone; null where its page has to be read."""
    human = F.concat(F.lit("https://download.cncb.ac.cn/gsa-human/"), project)
    return F.when(project.startswith("http"), F.regexp_replace(project, r"/+\z", "")).when(project_kind(project) == "human", human)


def controlled(html: Column) -> Column:
    """Whether a project's page says that its access is controlled."""
    return F.contains(html, F.lit("Controlled access"))


def path_after(path: Column, project: Column) -> Column:
    """The part of a path behind the first <project>/, or the path."""
    mark = F.concat(project, F.lit("/"))
    return F.when(F.instr(path, mark) > 0, F.substring(path, F.instr(path, mark) + F.length(mark), F.length(path))).otherwise(path)


def study_id(html: Column) -> Column:
    """The first number behind study_id; null where there is none."""
    return F.nullif(F.regexp_extract(html, r"study_id[^0-9]*([0-9]+)", 1), F.lit(""))


def project_urls(html: Column, project: Column | str, holding: str = "download") -> Column:
    """The distinct URLs of a page that end in the project (a text, or a column of one a row) and hold a word, in order."""
    found = F.regexp_extract_all(html, F.concat(F.lit("http[^< =]+"), project if isinstance(project, Column) else F.lit(project)), 0)
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: F.contains(u, F.lit(holding)))))


def sample_name(path: Column) -> Column:
    """The base name of a read file without .gz and .fastq or .fq; sample where nothing is left."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?<=.)\.(gz|GZ)\z", "")
    name = F.regexp_replace(name, r"(?<=.)\.(fastq|fq)\z", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("sample"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def query_url(base: str, **params: Column | str) -> Column:
    """base?name=value&..., with values URL-encoded."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in params.items()]
    return F.concat(F.lit(base + "?"), reduce(lambda a, b: F.concat(a, F.lit("&"), b), parts))
