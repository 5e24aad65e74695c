"""Source files in four languages made from the documents, and what they declare as DuckDB SQL.

A file has a class with a property and a method for each remainder that the lengths of the text's lines leave (by 5);
a method calls a function for each remainder of the blanks of those lines (by 6). Four functions are in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources.fixtures import load

_METHODS = {
    0: ("  m", "() { this.size; ", " }"),
    1: ("    def m", "(self): self.size; ", ""),
    2: ("func (d *Doc) m", "() { d.size; ", " }"),
    3: ("  void m", "() { this.size = 1; ", " }"),
}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, language, content)"""
    pair = F.transform(F.split("text", "\n"), lambda x: F.struct((F.length(x) % 5).alias("m"), ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) % 6).alias("c")))
    d = load(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("k"), F.array_sort(F.array_distinct(pair)).alias("pairs"))
    d = d.withColumn("ms", F.array_distinct(F.transform("pairs", lambda p: p["m"])))

    def methods(k: int):
        head, mid, tail = _METHODS[k]
        calls = lambda m: F.array_join(F.transform(F.filter("pairs", lambda p: p["m"] == m), lambda p: F.concat(F.lit("f"), p["c"].cast("string"), F.lit("();"))), " ")
        return F.array_join(F.transform("ms", lambda m: F.concat(F.lit(head), m.cast("string"), F.lit(mid), calls(m), F.lit(tail), F.lit("\n"))), "")

    a, base = (F.col("doc_id") % 5).cast("string"), (F.col("doc_id") % 3).cast("string")
    four = lambda text: F.lit("".join(text.format(j) for j in range(4)))
    made = F.when(F.col("k") == 0, F.concat(F.lit("import { a"), a, F.lit(" } from './lib';\nexport class Doc extends Base"), base, F.lit(" {\n  size = 1;\n"), methods(0), F.lit("}\nclass Base0 {}\n"), four("function f{0}() {{}}\n")))
    made = made.when(F.col("k") == 1, F.concat(F.lit("import lib.a"), a, F.lit("\nclass Doc(Base"), base, F.lit("):\n    size = 1\n"), methods(1), F.lit("class Base0: pass\n"), four("def f{0}(): pass\n")))
    made = made.when(F.col("k") == 2, F.concat(F.lit('package p\nimport "lib/a'), a, F.lit('"\ntype Doc struct {\n  size int\n}\n'), methods(2), four("func f{0}() {{}}\n")))
    made = made.otherwise(F.concat(F.lit("import lib.a"), a, F.lit(";\npublic class Doc extends Base"), base, F.lit(" {\n  int size = 1;\n"), methods(3), four("  void f{0}() {{}}\n"), F.lit("}\nclass Base0 {}\n")))
    language = F.element_at(F.array(*map(F.lit, ("typescript", "python", "go", "java"))), F.col("k").cast("int") + 1)
    return d.select("doc_id", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("."), language).alias("path"), language.alias("language"), made.alias("content"))


#: s: what each file declares. n: number of methods; r: a method's place among them.
SOURCES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
pairs AS (SELECT DISTINCT doc_id, length(l) % 5 AS m, (length(l) - length(replace(l, ' ', ''))) % 6 AS c FROM lines),
ms AS (SELECT doc_id, m, row_number() OVER (PARTITION BY doc_id ORDER BY m) - 1 AS r FROM (SELECT DISTINCT doc_id, m FROM pairs)),
n AS (SELECT doc_id, count(*) AS n, doc_id % 4 AS k, 'src/' || doc_id || '.' || (['typescript', 'python', 'go', 'java'])[doc_id % 4 + 1] AS path FROM ms GROUP BY doc_id),
s AS (SELECT path, 'Class' AS type, 'Doc' AS name, CASE k WHEN 2 THEN 3 ELSE 2 END AS start_line, CASE k WHEN 0 THEN 4 + n WHEN 1 THEN 3 + n WHEN 2 THEN 5 ELSE 8 + n END AS end_line, NULL AS parent, true AS exported FROM n
  UNION ALL SELECT path, 'Variable', 'size', CASE k WHEN 2 THEN 4 ELSE 3 END, CASE k WHEN 2 THEN 4 ELSE 3 END, 'Doc', k < 2 FROM n
  UNION ALL SELECT path, 'Method', 'm' || m, CASE k WHEN 2 THEN 6 ELSE 4 END + r, CASE k WHEN 2 THEN 6 ELSE 4 END + r, 'Doc', k < 2 FROM n JOIN ms USING (doc_id)
  UNION ALL SELECT path, 'Class', 'Base0', CASE k WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 9 END + n, CASE k WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 9 END + n, NULL, k <> 0 FROM n WHERE k <> 2
  UNION ALL SELECT path, CASE k WHEN 3 THEN 'Method' ELSE 'Function' END, 'f' || j, CASE k WHEN 1 THEN 5 WHEN 3 THEN 4 ELSE 6 END + n + j, CASE k WHEN 1 THEN 5 WHEN 3 THEN 4 ELSE 6 END + n + j, CASE k WHEN 3 THEN 'Doc' END, k = 1 FROM n, range(4) AS t(j))"""

RELATIONS = """SELECT n.path, 'm' || m AS from_name, 'CALLS' AS type, CASE WHEN c < 4 THEN 'f' || c ELSE 'call:f' || c END AS to_name, CASE WHEN c < 4 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, NULL AS reason FROM pairs JOIN n USING (doc_id)
UNION ALL SELECT path, name, 'ACCESSES', 'size', 0.8, CASE WHEN path LIKE '%.java' THEN 'write:size' ELSE 'read:size' END FROM s WHERE name LIKE 'm%'
UNION ALL SELECT path, 'Doc', CASE type WHEN 'Variable' THEN 'HAS_PROPERTY' ELSE 'HAS_METHOD' END, name, 1.0, NULL FROM s WHERE parent IS NOT NULL
UNION ALL SELECT path, name, 'IMPORTS', CASE k WHEN 0 THEN 'import:./lib:a' || b WHEN 2 THEN 'import:lib/a' || b || ':a' || b ELSE 'import:lib.a' || b || ':a' || b END, 0.6, CASE k WHEN 0 THEN './lib' WHEN 2 THEN 'lib/a' || b ELSE 'lib.a' || b END FROM (SELECT *, doc_id % 5 AS b FROM n) JOIN s USING (path) WHERE parent IS NULL
UNION ALL SELECT path, 'Doc', 'EXTENDS', CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 'Base0' ELSE 'extends:Base' || (doc_id % 3) END, CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 0.95 ELSE 0.7 END, CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 'same-file' END FROM n WHERE k <> 2"""

#: The files themselves, rendered.
CONTENT = """calls AS (SELECT doc_id, m, string_agg('f' || c || '();', ' ' ORDER BY c) AS calls FROM pairs GROUP BY ALL),
body AS (SELECT doc_id, string_agg(CASE doc_id % 4 WHEN 0 THEN '  m' || m || '() { this.size; ' || calls || ' }' WHEN 1 THEN '    def m' || m || '(self): self.size; ' || calls WHEN 2 THEN 'func (d *Doc) m' || m || '() { d.size; ' || calls || ' }' ELSE '  void m' || m || '() { this.size = 1; ' || calls || ' }' END || chr(10), '' ORDER BY m) AS b FROM calls GROUP BY doc_id),
rendered AS (SELECT path, replace(CASE k WHEN 0 THEN 'import { a' || doc_id % 5 || ' } from ''./lib'';~export class Doc extends Base' || doc_id % 3 || ' {~  size = 1;~' || b || '}~class Base0 {}~function f0() {}~function f1() {}~function f2() {}~function f3() {}~'
  WHEN 1 THEN 'import lib.a' || doc_id % 5 || '~class Doc(Base' || doc_id % 3 || '):~    size = 1~' || b || 'class Base0: pass~def f0(): pass~def f1(): pass~def f2(): pass~def f3(): pass~'
  WHEN 2 THEN 'package p~import "lib/a' || doc_id % 5 || '"~type Doc struct {~  size int~}~' || b || 'func f0() {}~func f1() {}~func f2() {}~func f3() {}~'
  ELSE 'import lib.a' || doc_id % 5 || ';~public class Doc extends Base' || doc_id % 3 || ' {~  int size = 1;~' || b || '  void f0() {}~  void f1() {}~  void f2() {}~  void f3() {}~}~class Base0 {}~' END, '~', chr(10)) AS content FROM n JOIN body USING (doc_id))"""
