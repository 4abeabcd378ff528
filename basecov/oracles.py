"""ANSI SQL counterparts of the registered queries, written row by row over bases instead of over stretches.

Each query is a chain of common table expressions; ``_sql`` adds the ones a query needs in front of it.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, needs: tuple[str, ...], text: str) -> None:
    CTES[name] = (needs, text)


def _ordered(names: tuple[str, ...], seen: dict[str, None]) -> dict[str, None]:
    for name in names:
        _ordered(CTES[name][0], seen)
        seen.setdefault(name)
    return seen


def _sql(needs: tuple[str, ...], select: str) -> str:
    parts = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in _ordered(needs, {}))
    return f"WITH {parts}\n{select}"


def oracle(name: str, needs: tuple[str, ...], select: str) -> None:
    ORACLES[name] = _sql(needs, select)


SAMPLES = range(8)
COLUMNS = ", ".join(f"c{s}" for s in SAMPLES)
X, Y = "[c0, c1, c2, c3]", "[c4, c5, c6, c7]"


def counts_of(value: str) -> str:
    return ", ".join(f"CAST(coalesce(sum({value}) FILTER (sample_id = {s}), 0) AS INTEGER) AS c{s}" for s in SAMPLES)


def joined(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda v: CAST(v AS VARCHAR)), ',')"


def ecdf_gaps(x: str, y: str, pool: str) -> str:
    return (
        f"list_transform({pool}, lambda z: "
        f"len(list_filter({x}, lambda a: a <= z)) / 4.0 - len(list_filter({y}, lambda b: b <= z)) / 4.0)"
    )


def cvm(x: str, y: str, pool: str) -> str:
    return f"list_sum(list_transform({ecdf_gaps(x, y, pool)}, lambda d: d * d)) * 16.0 / 64.0"


def ks(x: str, y: str, pool: str) -> str:
    return f"list_max(list_transform({ecdf_gaps(x, y, pool)}, lambda d: abs(d)))"


def half_up(value: str, digits: int) -> str:
    return f"floor({value} * 1e{digits} + 0.5) / 1e{digits}"


def padded(value: str, width: int) -> str:
    return f"rpad({value}, CAST(greatest({width}, length({value})) AS INTEGER), ' ')"


cte(
    "reads",
    (),
    """
    SELECT CAST(l_suppkey % 8 AS INTEGER) AS sample_id,
           concat('chr', CAST(l_partkey % 3 + 1 AS VARCHAR)) AS chrom,
           CAST(l_orderkey + 1 AS INTEGER) AS start_pos,
           CAST(l_orderkey + l_quantity AS INTEGER) AS end_pos,
           row_number() OVER () AS read_no
    FROM lineitem""",
)
cte(
    "exons",
    (),
    """
    SELECT concat('G', lpad(CAST(CAST(floor(p_partkey / 10) AS INTEGER) AS VARCHAR), 6, '0')) AS gene_id,
           concat('E', lpad(CAST(p_partkey AS VARCHAR), 7, '0')) AS exon_id,
           concat('chr', CAST(CAST(floor(p_partkey / 10) AS INTEGER) % 3 + 1 AS VARCHAR)) AS chrom,
           CAST(floor(p_partkey / 10) * 75 + (p_partkey % 10) * 20 + 1 AS INTEGER) AS start_pos,
           CAST(floor(p_partkey / 10) * 75 + (p_partkey % 10) * 20 + p_size + 10 AS INTEGER) AS end_pos,
           '.' AS strand
    FROM part""",
)
cte(
    "base_cov",
    ("reads",),
    """
    SELECT sample_id, chrom, CAST(pos AS INTEGER) AS pos, CAST(count(*) AS INTEGER) AS cov
    FROM (SELECT sample_id, chrom, unnest(range(start_pos, end_pos + 1)) AS pos FROM reads)
    GROUP BY 1, 2, 3""",
)
cte(
    "vec",
    ("base_cov",),
    f"""
    SELECT *, (c0 + c1 + c2 + c3) / 4.0 AS avg_a, (c4 + c5 + c6 + c7) / 4.0 AS avg_b,
           CASE WHEN c4 + c5 + c6 + c7 = 0 THEN CAST('Infinity' AS DOUBLE)
                ELSE CAST(c0 + c1 + c2 + c3 AS DOUBLE) / (c4 + c5 + c6 + c7) END AS fc
    FROM (SELECT chrom, pos, {counts_of("cov")} FROM base_cov GROUP BY 1, 2)
    WHERE c0 + c1 + c2 + c3 >= 4 OR c4 + c5 + c6 + c7 >= 4""",
)
cte(
    "nulls",
    (),
    f"""
    SELECT t, ways, sum(ways) OVER (ORDER BY t) / 70.0 AS cdf, sum(ways) OVER (ORDER BY t DESC) / 70.0 AS tail
    FROM (SELECT t, count(*) AS ways
          FROM (SELECT {cvm("x", "y", "[0, 1, 2, 3, 4, 5, 6, 7]")} AS t
                FROM (SELECT list_filter([0, 1, 2, 3, 4, 5, 6, 7], lambda i: (mask >> i) & 1 = 1) AS x,
                             list_filter([0, 1, 2, 3, 4, 5, 6, 7], lambda i: (mask >> i) & 1 = 0) AS y
                      FROM range(256) AS r(mask) WHERE bit_count(mask) = 4))
          GROUP BY t)""",
)
cte("scored", ("vec",), f"SELECT *, {cvm(X, Y, f'list_concat({X}, {Y})')} AS t FROM vec")
cte(
    "p_of_t",
    ("scored", "nulls"),
    """
    SELECT s.t, CASE WHEN s.t > (SELECT max(t) FROM nulls) THEN (SELECT min(tail) FROM nulls)
                     ELSE 1 - coalesce(max(n.cdf), 0) END AS p
    FROM (SELECT DISTINCT t FROM scored) s LEFT JOIN nulls n ON n.t < s.t - 1e-9
    GROUP BY s.t""",
)
cte(
    "tested",
    ("p_of_t",),
    "SELECT chrom, pos, s.t, p, fc, avg_a, avg_b FROM scored s JOIN p_of_t q ON q.t = s.t WHERE p <= 0.1",
)
cte(
    "runs",
    ("tested",),
    """
    SELECT chrom, CAST(min(pos) AS INTEGER) AS start_pos, CAST(count(*) AS INTEGER) AS length, max(p) AS p,
           avg(fc) AS fc, avg(avg_a) AS avg_a, avg(avg_b) AS avg_b
    FROM (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS island FROM tested)
    GROUP BY chrom, island""",
)
cte(
    "runs_equal",
    ("tested",),
    """
    SELECT chrom, CAST(min(pos) AS INTEGER) AS start_pos, CAST(count(*) AS INTEGER) AS length, max(p) AS p,
           avg(fc) AS fc, avg(avg_a) AS avg_a, avg(avg_b) AS avg_b
    FROM (SELECT *, round(p, 9) AS p9,
                 pos - row_number() OVER (PARTITION BY chrom, round(p, 9) ORDER BY pos) AS island FROM tested)
    GROUP BY chrom, p9, island""",
)


def exon_map(runs: str, exons: str) -> str:
    return f"""
    SELECT r.chrom, r.start_pos, r.length, r.p, r.fc, r.avg_a, r.avg_b,
           coalesce(b.gene_id, CASE WHEN r.chrom IN (SELECT chrom FROM {exons}) THEN 'PositionNotFound'
                                    ELSE 'ChrNotFound' END) AS gene_id,
           coalesce(b.exon_id, '0') AS exon_id,
           coalesce({half_up("b.share", 4)}, 0.0) AS overlap_pct
    FROM {runs} r
    LEFT JOIN (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY chrom, start_pos, gene_id
                                     ORDER BY share DESC, exon_start DESC, exon_id DESC) AS place
        FROM (SELECT r.chrom, r.start_pos, e.gene_id, e.exon_id, e.start_pos AS exon_start,
                     least(r.start_pos + r.length, e.end_pos) - greatest(r.start_pos, e.start_pos) AS ov,
                     (least(r.start_pos + r.length, e.end_pos) - greatest(r.start_pos, e.start_pos))
                       / CAST(e.end_pos - e.start_pos AS DOUBLE) AS share
              FROM {runs} r JOIN {exons} e ON r.chrom = e.chrom
                AND least(r.start_pos + r.length, e.end_pos) - greatest(r.start_pos, e.start_pos) > 1))
      WHERE place = 1) b ON b.chrom = r.chrom AND b.start_pos = r.start_pos"""


def signed(value: str) -> str:
    return (
        f"CASE WHEN {value} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {value} < 1 THEN -1.0 / {value} ELSE {value} END"
    )


def merged(mapped: str, connected: str) -> str:
    return f"""
    SELECT chrom, CAST(min(start_pos) AS INTEGER) AS start_pos, CAST(sum(length) AS INTEGER) AS length, max(p) AS p,
           sum(fc * length) / sum(length) AS fc, gene_id, exon_id,
           {half_up("sum(overlap_pct)", 4)} AS overlap_pct,
           sum(avg_a * length) / sum(length) AS avg_a, sum(avg_b * length) / sum(length) AS avg_b
    FROM (SELECT *, sum(brk) OVER (PARTITION BY gene_id, exon_id, chrom ORDER BY start_pos) AS part
          FROM (SELECT *, CASE WHEN {connected} THEN 0 ELSE 1 END AS brk
                FROM (SELECT * REPLACE ({signed("fc")} AS fc,
                                        CASE WHEN exon_id = '0' THEN concat('NEWREG', chrom) ELSE gene_id END AS gene_id)
                      FROM {mapped})
                WINDOW w AS (PARTITION BY gene_id, exon_id, chrom ORDER BY start_pos)))
    GROUP BY gene_id, exon_id, chrom, part"""


cte("mapped", ("runs", "exons"), exon_map("runs", "exons"))
cte("mapped_equal", ("runs_equal", "exons"), exon_map("runs_equal", "exons"))
cte(
    "merged",
    ("mapped",),
    merged(
        "mapped",
        "start_pos - 1 = lag(start_pos + length) OVER w AND sign(fc) = sign(lag(fc) OVER w)",
    ),
)
cte(
    "merged_equal",
    ("mapped_equal",),
    merged(
        "mapped_equal",
        "start_pos - lag(start_pos + length) OVER w IN (0, 1) AND sign(fc) = sign(lag(fc) OVER w) "
        "AND round(p, 9) = round(lag(p) OVER w, 9)",
    ),
)
cte("regions", ("merged",), "SELECT * FROM merged WHERE length >= 10")
cte(
    "hits",
    ("reads", "exons"),
    """
    SELECT r.read_no, r.sample_id, e.gene_id, e.exon_id
    FROM reads r JOIN exons e ON r.chrom = e.chrom AND r.start_pos <= e.end_pos AND r.end_pos >= e.start_pos""",
)
cte(
    "region_cov",
    ("hits",),
    "SELECT sample_id, gene_id, exon_id, count(*) AS cov FROM hits GROUP BY 1, 2, 3",
)
cte(
    "exon_vec",
    ("region_cov",),
    f"""
    SELECT *, CASE WHEN c4 + c5 + c6 + c7 = 0 THEN CAST('Infinity' AS DOUBLE)
                   ELSE CAST(c0 + c1 + c2 + c3 AS DOUBLE) / (c4 + c5 + c6 + c7) END AS fc
    FROM (SELECT gene_id, exon_id, {counts_of("cov")} FROM region_cov GROUP BY 1, 2)""",
)
cte(
    "splits",
    ("exon_vec",),
    f"""
    SELECT gene_id, exon_id, fc, mask, {X} AS ox, {Y} AS oy, list_concat({X}, {Y}) AS pool,
           list_filter(list_concat({X}, {Y}), lambda v, i: (mask >> (i - 1)) & 1 = 1) AS x,
           list_filter(list_concat({X}, {Y}), lambda v, i: (mask >> (i - 1)) & 1 = 0) AS y
    FROM exon_vec, (SELECT mask FROM range(256) AS r(mask) WHERE bit_count(mask) = 4)""",
)
cte(
    "perm",
    ("splits",),
    f"""
    SELECT gene_id, exon_id, any_value(fc) AS fc,
           avg(CASE WHEN greatest({cvm("x", "y", "pool")}, {ks("x", "y", "pool")})
                         >= greatest({cvm("ox", "oy", "pool")}, {ks("ox", "oy", "pool")}) - 1e-9
                    THEN 1.0 ELSE 0.0 END) AS p2
    FROM splits GROUP BY gene_id, exon_id""",
)
cte(
    "confirmed",
    ("regions", "perm"),
    "SELECT r.*, p2 FROM regions r JOIN perm q ON q.gene_id = r.gene_id AND q.exon_id = r.exon_id",
)
cte(
    "summary",
    ("confirmed",),
    """
    SELECT gene_id, exon_id, max(p2) AS p2, sum(p * length) / sum(length) AS p1, sum(fc * length) / sum(length) AS fc,
           sum(overlap_pct) AS overlap_pct, sum(avg_a * length) / sum(length) AS avg_a,
           sum(avg_b * length) / sum(length) AS avg_b
    FROM confirmed GROUP BY gene_id, exon_id""",
)

REGION = (
    "chrom, start_pos, length, round(p, 6) AS p, round(fc, 6) AS fc, gene_id, exon_id, "
    "round(overlap_pct, 6) AS overlap_pct, round(avg_a, 6) AS avg_a, round(avg_b, 6) AS avg_b"
)
RUN = (
    "chrom, start_pos, length, round(p, 6) AS p, round(fc, 6) AS fc, round(avg_a, 6) AS avg_a, "
    "round(avg_b, 6) AS avg_b"
)
STARS = (
    "CASE WHEN avg_a < 2 AND avg_b < 2 THEN '*' WHEN avg_a >= 100 OR avg_b >= 100 THEN '****' "
    "WHEN avg_a >= 10 OR avg_b >= 10 THEN '***' ELSE '**' END"
)
TOP_ORDER = "p2, abs(fc) DESC, length DESC, gene_id, exon_id, chrom, start_pos"
TABLE = ", ".join(
    f"CAST(coalesce(sum(cov) FILTER (sample_id = {s}), 0) AS BIGINT) AS s{s}" for s in SAMPLES
)

# --- coverage
oracle("base_coverage", ("base_cov",), "SELECT sample_id, chrom, pos, cov FROM base_cov")
oracle("base_depth_filter", ("base_cov",), "SELECT count(*) AS n_bases FROM base_cov WHERE cov >= 10")
oracle(
    "base_coverage_region",
    ("base_cov",),
    "SELECT sample_id, chrom, pos, cov FROM base_cov WHERE chrom = 'chr1' AND pos BETWEEN 101 AND 40000",
)
oracle(
    "base_coverage_point",
    ("base_cov",),
    "SELECT sample_id * 1000000000000 + 1000000000 + pos AS packed_id, cov FROM base_cov "
    "WHERE chrom = 'chr1' AND pos = 240",
)
oracle(
    "packed_ids",
    ("reads",),
    """
    SELECT packed_id, sample_id, packed_id % 1000000000000 AS position_id, packed_id % 100000000000 AS region_id,
           chrom_num, chrom, start_pos AS pos,
           concat('ENSE', lpad(CAST(packed_id % 1000000000000 AS VARCHAR), 11, '0')) AS stable_id
    FROM (SELECT *, CAST(substr(chrom, 4) AS INTEGER) AS chrom_num,
                 CAST(sample_id AS BIGINT) * 1000000000000 + CAST(substr(chrom, 4) AS BIGINT) * 1000000000 + start_pos
                   AS packed_id
          FROM reads)""",
)
oracle(
    "library_norm",
    ("base_cov",),
    """
    , n AS (SELECT sample_id, CASE WHEN sample_id < 4 THEN 'case' ELSE 'control' END AS grp, count(*) AS n_reads
            FROM reads GROUP BY 1, 2),
    f AS (SELECT a.sample_id, a.grp, a.n_reads, CAST(b.n_reads AS DOUBLE) / a.n_reads AS norm_factor
          FROM n a JOIN n b ON b.grp = a.grp AND b.sample_id IN (0, 4))
    SELECT f.sample_id, grp, n_reads, round(norm_factor, 6) AS norm_factor, count(*) AS n_bases,
           CAST(sum(CAST(round(cov * norm_factor) AS INTEGER)) AS BIGINT) AS scaled_cov
    FROM f JOIN base_cov c ON c.sample_id = f.sample_id GROUP BY 1, 2, 3, 4""",
)
oracle("sample_counts", ("reads",), "SELECT sample_id, count(*) AS n_reads FROM reads GROUP BY 1")
oracle("region_coverage", ("region_cov",), "SELECT sample_id, gene_id, exon_id, cov FROM region_cov")
oracle(
    "sample_list",
    ("reads",),
    "SELECT concat('sample_', sample_id, '.bam') AS path, count(*) AS n_reads FROM reads GROUP BY sample_id",
)
oracle(
    "region_coverage_union",
    ("hits",),
    """
    SELECT sample_id, gene_id, exon_id, count(*) AS cov
    FROM (SELECT *, count(*) OVER (PARTITION BY read_no) AS n FROM hits) WHERE n = 1 GROUP BY 1, 2, 3""",
)
oracle("gene_coverage_table", ("region_cov",), f"SELECT gene_id, {TABLE} FROM region_cov GROUP BY gene_id")
oracle(
    "exon_coverage_table", ("region_cov",), f"SELECT gene_id, exon_id, {TABLE} FROM region_cov GROUP BY gene_id, exon_id"
)
oracle(
    "gene_coverage_list",
    ("region_cov",),
    f"SELECT gene_id, {TABLE} FROM region_cov "
    "WHERE gene_id IN (SELECT gene_id FROM exons WHERE end_pos - start_pos >= 58) GROUP BY gene_id",
)
oracle(
    "exon_count_join",
    ("region_cov",),
    """
    SELECT a.gene_id, a.exon_id, a.x, b.y
    FROM (SELECT gene_id, exon_id, string_agg(CAST(cov AS VARCHAR), ',' ORDER BY sample_id) AS x
          FROM region_cov WHERE sample_id < 4 GROUP BY 1, 2) a
    JOIN (SELECT gene_id, exon_id, string_agg(CAST(cov AS VARCHAR), ',' ORDER BY sample_id) AS y
          FROM region_cov WHERE sample_id >= 4 GROUP BY 1, 2) b
      ON a.gene_id = b.gene_id AND a.exon_id = b.exon_id""",
)

# --- vectors and statistics
for _name in ("position_vectors", "position_vectors_sparse"):
    oracle(_name, ("vec",), f"SELECT chrom, pos, {joined(X)} AS x, {joined(Y)} AS y FROM vec")
oracle(
    "vector_stats",
    ("vec",),
    f"""
    SELECT chrom, pos, round(avg_a, 6) AS mean_a, round(avg_b, 6) AS mean_b, round(list_stddev_pop({X}), 6) AS sd_a,
           round(list_stddev_pop({Y}), 6) AS sd_b, round(fc, 6) AS fc
    FROM vec""",
)
oracle("cvm_stat", ("scored",), "SELECT chrom, pos, round(t, 6) AS t FROM scored")
oracle("ks_stat", ("vec",), f"SELECT chrom, pos, round({ks(X, Y, f'list_concat({X}, {Y})')}, 6) AS d FROM vec")
oracle(
    "mw_stat",
    ("vec",),
    f"""
    SELECT chrom, pos, list_sum(list_transform({X}, lambda a: len(list_filter({Y}, lambda b: b < a))
                                                  + 0.5 * len(list_filter({Y}, lambda b: b = a)))) AS u
    FROM vec""",
)
oracle(
    "cvm_null",
    ("p_of_t",),
    """
    SELECT round(n.t, 6) AS t, ways, round(cdf, 6) AS cdf, round(tail, 6) AS tail, coalesce(n_bases, 0) AS n_bases
    FROM nulls n LEFT JOIN (SELECT round(p, 9) AS p9, count(*) AS n_bases
                            FROM scored s JOIN p_of_t q ON q.t = s.t GROUP BY 1) o ON o.p9 = round(n.tail, 9)""",
)
for _name in ("cvm_base_test", "cvm_base_test_table"):
    oracle(
        _name,
        ("tested",),
        "SELECT chrom, pos, round(t, 6) AS t, round(p, 6) AS p, round(fc, 6) AS fc, round(avg_a, 6) AS avg_a, "
        "round(avg_b, 6) AS avg_b FROM tested",
    )
oracle(
    "fisher_combined",
    ("tested",),
    """
    , w AS (SELECT chrom, CAST(pos // 100 AS INTEGER) AS win, -2 * sum(ln(p)) AS stat,
                   CAST(2 * count(*) AS INTEGER) AS dof
            FROM tested GROUP BY 1, 2),
    q AS (SELECT *, list_sum(list_transform(range(dof // 2),
                     lambda i: exp(-stat / 2 + i * ln(stat / 2) - lgamma(i + 1)))) AS p FROM w)
    SELECT chrom, win, round(stat, 6) AS stat, dof, round(least(p, 1.0), 6) AS p,
           round(least(p, greatest(1 - p, 0.0)), 6) AS p_folded FROM q""",
)
oracle(
    "vector_scalars",
    ("vec",),
    f"""
    SELECT chrom, pos, concat_ws(',', c1, c2, c4, c7) AS chosen, concat_ws(',', c0, c3, c5, c6) AS rest,
           70 AS ways, CAST(sign(c0 - c4) AS DOUBLE) AS direction, abs(c0 - c4) AS size, greatest(c0, c4) AS larger,
           least(c0, c4) AS smaller, round(sqrt(avg_a), 6) AS root, round(avg_b * avg_b, 6) AS square,
           round(ln(avg_a + 1), 6) AS log
    FROM vec""",
)

# --- regions
oracle("islands_le", ("runs",), f"SELECT {RUN} FROM runs")
oracle("islands_equal", ("runs_equal",), f"SELECT {RUN} FROM runs_equal")
oracle("region_exon_map", ("mapped",), f"SELECT {REGION} FROM mapped")
oracle(
    "point_exon_lookup",
    ("reads", "exons"),
    """
    SELECT sample_id, chrom, pos,
           CASE WHEN known THEN coalesce(gene_id, '') ELSE 'ExonNotFound' END AS gene_id,
           CASE WHEN known THEN coalesce(exon_id, '') ELSE '0' END AS exon_id,
           coalesce(exon_start, 0) AS exon_start, coalesce(exon_end, 0) AS exon_end
    FROM (SELECT r.sample_id, r.chrom, r.start_pos AS pos, r.chrom IN (SELECT chrom FROM exons) AS known,
                 e.gene_id, e.exon_id, e.start_pos AS exon_start, e.end_pos AS exon_end,
                 row_number() OVER (PARTITION BY r.read_no ORDER BY e.start_pos, e.exon_id) AS place
          FROM reads r LEFT JOIN exons e
            ON e.chrom = r.chrom AND r.start_pos BETWEEN e.start_pos AND e.end_pos)
    WHERE place = 1""",
)
oracle(
    "exon_range_lookup",
    ("region_cov",),
    """
    SELECT c.gene_id, c.exon_id, c.sample_id, c.cov, e.chrom AS exon_chrom, e.start_pos AS exon_start,
           e.end_pos AS exon_end
    FROM region_cov c JOIN exons e ON e.gene_id = c.gene_id AND e.exon_id = c.exon_id""",
)
oracle("signed_fold_change", ("tested",), f"SELECT chrom, pos, round({signed('fc')}, 6) AS fc FROM tested")
oracle("coalesce_regions", ("merged",), f"SELECT {REGION} FROM merged")
oracle("coalesce_regions_equal_p", ("merged_equal",), f"SELECT {REGION} FROM merged_equal")
oracle("phase1_regions", ("regions",), f"SELECT {REGION} FROM regions")
oracle(
    "exon_candidates",
    ("regions",),
    """
    SELECT gene_id, exon_id, chrom, start_pos, end_pos, strand FROM exons
    WHERE (gene_id, exon_id) IN (SELECT (gene_id, exon_id) FROM regions)""",
)
oracle(
    "new_region_candidates",
    ("merged",),
    """
    SELECT concat('NEWREG', lpad(CAST(row_number() OVER (ORDER BY chrom, start_pos, end_pos) AS VARCHAR), 9, '0'))
             AS gene_id, '0' AS exon_id, chrom, start_pos, end_pos, '.' AS strand
    FROM (SELECT DISTINCT chrom, start_pos, start_pos + length AS end_pos FROM merged WHERE exon_id = '0')""",
)

# --- phase 2 and reports
oracle(
    "permutation_test", ("perm",), "SELECT gene_id, exon_id, round(p2, 6) AS p2, round(fc, 6) AS fc FROM perm"
)


def u_of(x: str, y: str) -> str:
    return (
        f"list_sum(list_transform({x}, lambda a: len(list_filter({y}, lambda b: b < a)) "
        f"+ 0.5 * len(list_filter({y}, lambda b: b = a))))"
    )


UNEQUAL = "list_transform(pool, lambda z: len(list_filter({0}, lambda a: a <= z)) / 5.0 - len(list_filter({1}, lambda b: b <= z)) / 3.0)"
BOTH = "greatest(list_sum(list_transform({0}, lambda d: d * d)) * 15.0 / 64.0, list_max(list_transform({0}, lambda d: abs(d))))"
oracle(
    "permutation_test_unequal",
    ("exon_vec",),
    f"""
    , tried AS (
        SELECT gene_id, exon_id, pool, pool[1:5] AS ox, pool[6:8] AS oy,
               list_filter(pool, lambda v, i: (mask >> (i - 1)) & 1 = 1) AS x, list_filter(pool, lambda v, i: (mask >> (i - 1)) & 1 = 0) AS y
        FROM (SELECT gene_id, exon_id, list_concat({X}, {Y}) AS pool FROM exon_vec), (SELECT mask FROM range(256) AS r(mask) WHERE bit_count(mask) = 5))
    SELECT gene_id, exon_id,
           round(avg(CASE WHEN {BOTH.format(UNEQUAL.format("x", "y"))} >= {BOTH.format(UNEQUAL.format("ox", "oy"))} - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p2
    FROM tried GROUP BY gene_id, exon_id""",
)
for _name in ("permutation_test_plugin", "permutation_test_batched"):
    oracle(
        _name,
        ("splits",),
        f"""
    SELECT gene_id, exon_id,
           round(avg(CASE WHEN {u_of("x", "y")} >= {u_of("ox", "oy")} - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS p2
    FROM splits GROUP BY gene_id, exon_id""",
    )
oracle("phase2_regions", ("confirmed",), f"SELECT {REGION}, round(p2, 6) AS p2 FROM confirmed")
oracle(
    "de_job", ("confirmed",), f"SELECT {REGION}, round(p2, 6) AS p2, 'results_10_whole_0.1' AS job FROM confirmed"
)
SUMMARY = (
    "SELECT gene_id, exon_id, round(p2, 6) AS p2, round(p1, 6) AS p1, round(fc, 6) AS fc, "
    "round(overlap_pct, 6) AS overlap_pct, round(avg_a, 6) AS avg_a, round(avg_b, 6) AS avg_b FROM summary"
)
oracle("exon_summary", ("summary",), SUMMARY)
oracle(
    "exon_summary_ranked",
    ("summary",),
    "SELECT *, row_number() OVER (ORDER BY p2 NULLS FIRST, fc DESC NULLS LAST, gene_id, exon_id) AS place "
    f"FROM ({SUMMARY})",
)
oracle(
    "top_regions",
    ("confirmed",),
    f"SELECT {REGION}, round(p2, 6) AS p2 FROM (SELECT * FROM confirmed ORDER BY {TOP_ORDER} LIMIT 20)",
)


def shown(value: str, digits: int) -> str:
    return f"CAST({half_up(value, digits)} AS VARCHAR)"


def fold_shown(value: str) -> str:
    """A rounded infinite fold change shows the limit of the 64-bit integers that rounding goes through."""
    return (
        f"CASE WHEN isinf({value}) THEN CASE WHEN {value} > 0 THEN '9.223372036854777E13' "
        f"ELSE '-9.223372036854777E13' END ELSE {shown(f'CASE WHEN isinf({value}) THEN 0 ELSE {value} END', 5)} END"
    )


oracle(
    "region_report",
    ("confirmed",),
    f"""
    SELECT concat({padded(shown("p2", 5), 15)}, {padded(shown("p", 5), 15)}, {padded(fold_shown("fc"), 25)},
                  {padded("CAST(length AS VARCHAR)", 10)},
                  {padded("concat('(', chrom, ',', CAST(start_pos AS VARCHAR), ')')", 20)},
                  {padded("gene_id", 25)}, {padded("exon_id", 25)}, {padded("CAST(overlap_pct AS VARCHAR)", 15)},
                  {padded(shown("avg_a", 2), 10)}, {padded(shown("avg_b", 2), 10)}, {padded(STARS, 20)}) AS line
    FROM confirmed""",
)
oracle(
    "exon_report",
    ("summary",),
    f"""
    SELECT concat({padded(shown("p2", 5), 15)}, {padded(fold_shown("fc"), 25)}, {padded("gene_id", 25)},
                  {padded("exon_id", 25)}, {padded(shown("overlap_pct", 5), 15)}, {padded(shown("avg_a", 2), 10)},
                  {padded(shown("avg_b", 2), 10)}, {padded(f"CAST(length({STARS}) AS VARCHAR)", 20)}) AS line
    FROM summary""",
)
oracle(
    "report_sinks",
    ("summary",),
    """
    SELECT 'phase1' AS sink, count(*) AS n FROM regions
    UNION ALL SELECT 'results', count(*) FROM confirmed
    UNION ALL SELECT 'exons', count(DISTINCT (gene_id, exon_id)) FROM regions WHERE exon_id <> '0'
    UNION ALL SELECT 'novel', count(DISTINCT (chrom, start_pos, length)) FROM regions WHERE exon_id = '0'
    UNION ALL SELECT 'report', count(*) + 1 FROM confirmed
    UNION ALL SELECT 'exon_report', count(*) + 1 FROM summary""",
)

# --- sources
TOTALS = """
    SELECT chrom, count(*) AS n_reads, CAST(sum(start_pos) AS BIGINT) AS sum_start,
           CAST(sum(end_pos) AS BIGINT) AS sum_end FROM reads GROUP BY chrom"""
oracle("sam_source", ("reads",), TOTALS)
oracle("bam_source", ("reads",), TOTALS)
oracle("bed_source", ("exons",), "SELECT gene_id, exon_id, chrom, start_pos, end_pos, strand FROM exons")
oracle(
    "bam_region_coverage",
    ("base_cov",),
    "SELECT chrom, pos, CAST(sum(cov) AS INTEGER) AS cov FROM base_cov WHERE chrom = 'chr1' AND pos BETWEEN 101 AND 40000 GROUP BY 1, 2",
)
oracle("sample_sheet_source", ("reads",), TOTALS.replace("SELECT chrom", "SELECT sample_id, chrom").replace("GROUP BY chrom", "GROUP BY sample_id, chrom"))
