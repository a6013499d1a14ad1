"""SQL of the file-name rules, for checks in another engine."""

NAMES = r"""
names AS (SELECT DISTINCT file_name AS known, regexp_replace(regexp_replace(file_name, '^\s+|\s+$', '', 'g'), '^(\./)+', '') AS bare
          FROM genomes WHERE file_name IS NOT NULL),
best AS (SELECT bare, min(known) AS best FROM names GROUP BY bare)
"""


def known(c: str) -> str:
    """The known spelling of file name ``c``: itself, or the smallest with its bare name."""
    bare = rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^(\./)+', '')"
    return f"coalesce((SELECT known FROM names WHERE known = {c}), (SELECT best FROM best WHERE bare = {bare}), {bare})"
