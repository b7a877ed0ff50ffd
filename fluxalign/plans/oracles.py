"""DuckDB SQL of the registered queries, for side-by-side comparison."""

from __future__ import annotations

SEEDS, SAMPLES = [42, 52, 62], 2000
VALUES_SEED = "(VALUES (42),(52),(62)) s(seed)"


def h(*parts: str) -> str:
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::BIGINT"


def u(*parts: str) -> str:
    return f"(({h(*parts)}::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def r(x: str, places: int = 6) -> str:
    return f"(round(({x})::DOUBLE,{places}) + 0.0)"


def cols(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


LABELS = "v_labels AS (SELECT d.doc_id AS sentence_id, d.text AS sentence, l.quality - l.toxic AS sentiment_label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"
META = f"""v_words AS (SELECT sentence_id, sentiment_label + 1 AS target, {WORDS.format('sentence')} AS word_count FROM v_labels),
v_meta AS (SELECT sentence_id, target, word_count, CASE WHEN word_count <= low THEN 'short' WHEN word_count > high THEN 'long' ELSE 'medium' END AS length_group
 FROM v_words, (SELECT quantile_cont(word_count, 0.25) AS low, quantile_cont(word_count, 0.75) AS high FROM v_words))"""
SAMPLES_V = "v_samples AS (SELECT user_id AS recording, event_type AS channel, ts, event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"
FEATURES = """v_features AS (SELECT vec_id // 5 AS sentence_id, vec_id % 5 AS subject, pos, CASE WHEN (vec_id + pos) % 13 = 0 OR pos = 7 THEN NULL ELSE v::DOUBLE END AS value
 FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels))),
v_flabels AS (SELECT DISTINCT sentence_id, (sentence_id % 3 - 1)::INT AS sentiment_label FROM v_features)"""

#: The same with every embedding.
EVERY_FEATURE = FEATURES.replace(" WHERE vec_id IN (SELECT doc_id FROM labels)", "")


def folds(source: str, seeds: str = VALUES_SEED) -> str:
    return f"""v_fold AS (SELECT x.sentence_id, x.sentiment_label, x.seed, ((o.off + x.rn - 1) % 5 + 1)::INT AS fold FROM
 (SELECT l.sentence_id, l.sentiment_label, s.seed, row_number() OVER (PARTITION BY s.seed, l.sentiment_label ORDER BY {h('s.seed', 'l.sentence_id')}, l.sentence_id) AS rn FROM {source} l, {seeds}) x
 JOIN (SELECT sentiment_label, sum(n) OVER (ORDER BY sentiment_label) - n AS off FROM (SELECT sentiment_label, count(*) AS n FROM {source} GROUP BY 1)) o ON x.sentiment_label = o.sentiment_label)"""


SPLITS = f"""v_every AS (SELECT f.sentence_id, f.sentiment_label, f.seed, f.fold AS own, k.fold::INT AS fold FROM v_fold f, (SELECT unnest(range(1, 6)) AS fold) k),
v_size AS (SELECT seed, fold, sentiment_label, count(*) AS n FROM v_every WHERE own <> fold GROUP BY ALL),
v_exact AS (SELECT *, sum(n) OVER (PARTITION BY seed, fold) AS n_fit FROM v_size),
v_base AS (SELECT *, ceil(n_fit * 0.15::DOUBLE) AS n_val, ceil(n_fit * 0.15::DOUBLE) * n / n_fit AS exact FROM v_exact),
v_quota AS (SELECT seed, fold, sentiment_label, floor(exact) + CASE WHEN row_number() OVER (PARTITION BY seed, fold ORDER BY round(exact - floor(exact), 9) DESC, sentiment_label) <= n_val - sum(floor(exact)) OVER (PARTITION BY seed, fold) THEN 1 ELSE 0 END AS quota FROM v_base),
v_split AS (SELECT sentence_id, sentiment_label, seed, fold, 'test' AS split FROM v_every WHERE own = fold UNION ALL
 SELECT e.sentence_id, e.sentiment_label, e.seed, e.fold, CASE WHEN e.rn <= q.quota THEN 'val' ELSE 'train' END FROM
 (SELECT *, row_number() OVER (PARTITION BY seed, fold, sentiment_label ORDER BY {h("'val'", 'seed', 'fold', 'sentence_id')}, sentence_id) AS rn FROM v_every WHERE own <> fold) e JOIN v_quota q USING (seed, fold, sentiment_label))"""
FEATURE_SPLITS = f"{FEATURES}, {folds('v_flabels')}, {SPLITS}"
PERMUTATION = f"""v_perm AS (SELECT a.seed, a.fold, a.split, a.sentence_id, b.sentence_id AS source_id FROM
 (SELECT *, row_number() OVER (PARTITION BY seed, fold, split ORDER BY {h("'to'", 'seed', 'fold', 'split', 'sentence_id')}, sentence_id) AS p FROM v_split) a JOIN
 (SELECT *, row_number() OVER (PARTITION BY seed, fold, split ORDER BY {h("'from'", 'seed', 'fold', 'split', 'sentence_id')}, sentence_id) AS p FROM v_split) b USING (seed, fold, split, p))"""


def fit(rows: str) -> str:
    return f"""v_median AS (SELECT seed, fold, pos, quantile_cont(value, 0.5) AS m FROM {rows} WHERE split = 'train' GROUP BY ALL),
v_fit AS (SELECT t.seed, t.fold, t.pos, m.m IS NOT NULL AS observed, coalesce(m.m, 0.0) AS median, avg(coalesce(t.value, m.m, 0.0)) AS mean, CASE WHEN stddev_pop(coalesce(t.value, m.m, 0.0)) >= 1e-8 THEN stddev_pop(coalesce(t.value, m.m, 0.0)) ELSE 1.0 END AS std
 FROM {rows} t JOIN v_median m USING (seed, fold, pos) WHERE t.split = 'train' GROUP BY t.seed, t.fold, t.pos, m.m)"""


def argmax(x: str) -> str:
    return f"(list_position({x}, list_max({x})) - 1)::INT"


_W = ", ".join(f"{u(chr(39) + 'w' + chr(39), 'sentence_id', 'seed', 'text_mode', str(k))} + CASE WHEN target = {k} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END" for k in range(3))
_C = ", ".join(f"0.3::DOUBLE * ({u(chr(39) + 'c' + chr(39), 'sentence_id', 'seed', 'text_mode', 'eeg_control', str(k))} - 0.5::DOUBLE) * live" for k in range(3))
PREDICTIONS = f"""v_grid AS (SELECT l.sentence_id, l.sentiment_label + 1 AS target, s.seed, m.text_mode, c.eeg_control, CASE WHEN c.eeg_control = 'zero' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS live
 FROM v_labels l, {VALUES_SEED}, (VALUES ('finetune'), ('frozen')) m(text_mode), (VALUES ('aligned'), ('shuffled'), ('noise'), ('zero')) c(eeg_control)),
v_raw AS (SELECT *, [{_W}] AS wo, [{_C}] AS added FROM v_grid),
v_pred AS (SELECT CASE WHEN eeg_control = 'aligned' THEN 'gated_' || text_mode ELSE 'gated_' || eeg_control || '_' || text_mode END AS setup, text_mode, eeg_control, seed, sentence_id, target, wo,
 [wo[1] + added[1], wo[2] + added[2], wo[3] + added[3]] AS wi, 1.0 + {u("'t'", 'sentence_id', 'seed', 'text_mode')} AS tn, 1.0 + {u("'e'", 'sentence_id', 'seed', 'text_mode', 'eeg_control')} AS en,
 0.2::DOUBLE * {u("'n'", 'sentence_id', 'seed', 'text_mode', 'eeg_control')} AS cn, live FROM v_raw),
v_scored AS (SELECT *, {argmax('wi')} AS prediction FROM v_pred)"""
BASE = f"{LABELS}, {PREDICTIONS}"
DIAG = f"""v_p AS (SELECT *, {argmax('wo')} AS pwo, list_max(wo) AS top, exp(wo[1] - list_max(wo)) AS e1, exp(wo[2] - list_max(wo)) AS e2, exp(wo[3] - list_max(wo)) AS e3 FROM v_scored),
v_diag AS (SELECT p.setup, p.text_mode, p.eeg_control, p.seed, p.sentence_id, p.target, ['negative', 'neutral', 'positive'][p.target + 1] AS class_name, m.word_count, m.length_group, p.prediction AS prediction_with_eeg, p.pwo AS prediction_without_eeg,
 (p.prediction = p.target)::INT AS correct_with_eeg, (p.pwo = p.target)::INT AS correct_without_eeg, (p.prediction <> p.pwo)::INT AS prediction_changed,
 (p.prediction = p.target AND p.pwo <> p.target)::INT AS favorable_flip, (p.pwo = p.target AND p.prediction <> p.target)::INT AS unfavorable_flip,
 greatest(e1, e2, e3) / (e1 + e2 + e3) AS text_path_confidence, (list_sort([e1, e2, e3])[3] - list_sort([e1, e2, e3])[2]) / (e1 + e2 + e3) AS text_path_margin,
 tn AS text_embedding_norm, en AS eeg_embedding_norm, cn AS candidate_eeg_contribution_norm, cn * live AS gated_eeg_contribution_norm, cn * live / greatest(tn, 1e-12) AS contribution_to_text_norm_ratio,
 sqrt((wi[1]-wo[1])*(wi[1]-wo[1]) + (wi[2]-wo[2])*(wi[2]-wo[2]) + (wi[3]-wo[3])*(wi[3]-wo[3])) AS logit_delta_l2 FROM v_p p JOIN v_meta m ON p.sentence_id = m.sentence_id)"""
DIAGNOSTICS = f"{LABELS}, {META}, {PREDICTIONS}, {DIAG}"


def confusion(target: str, prediction: str, prefix: str = "c") -> str:
    return ", ".join(f"sum(CASE WHEN {target} = {i} AND {prediction} = {j} THEN 1 ELSE 0 END) AS {prefix}{i}{j}" for i in range(3) for j in range(3))


def f1(k: int, p: str = "c") -> str:
    both = " + ".join([f"{p}{k}{j}" for j in range(3)] + [f"{p}{i}{k}" for i in range(3)])
    return f"coalesce(2.0::DOUBLE * {p}{k}{k} / nullif(({both})::DOUBLE, 0), 0.0::DOUBLE)"


def macro(p: str = "c", present: bool = False) -> str:
    total = " + ".join(f1(k, p) for k in range(3))
    if not present:
        return f"(({total}) / 3.0::DOUBLE)"
    here = " + ".join("(CASE WHEN " + " + ".join([f"{p}{k}{j}" for j in range(3)] + [f"{p}{i}{k}" for i in range(3)]) + " > 0 THEN 1 ELSE 0 END)" for k in range(3))
    return f"(({total}) / ({here})::DOUBLE)"


def metrics(by: str, source: str = "v_scored", name: str = "v_metrics") -> str:
    true = ["(" + " + ".join(f"c{k}{j}" for j in range(3)) + ")" for k in range(3)]
    weighted = " + ".join(f"{f1(k)} * {true[k]}" for k in range(3))
    return f"""{name} AS (SELECT *, (c00 + c11 + c22)::DOUBLE / n AS accuracy, {macro()} AS macro_f1, ({weighted}) / n AS weighted_f1, {f1(0)} AS f1_0, {f1(1)} AS f1_1, {f1(2)} AS f1_2
 FROM (SELECT {by}, count(*) AS n, {confusion('target', 'prediction')} FROM {source} GROUP BY {by}))"""


BY_FOLD = f"{folds('v_labels')}, v_byfold AS (SELECT p.*, f.fold FROM v_scored p JOIN v_fold f ON p.sentence_id = f.sentence_id AND p.seed = f.seed)"
GATES = f"v_gates AS (SELECT setup, seed, fold, 1.0 / (1.0 + exp(-(4 * {u(chr(39) + 'g' + chr(39), 'setup', 'seed', 'fold', 'k')} - 2))) AS gate FROM (SELECT DISTINCT setup, seed, fold FROM v_byfold), (SELECT unnest(range(4)) AS k))"


def quartile(by: str, source: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (rk, nn), CASE WHEN rk <= 1 + (nn - 1) * 0.25 THEN 'q1_lowest' WHEN rk <= 1 + (nn - 1) * 0.5 THEN 'q2' WHEN rk <= 1 + (nn - 1) * 0.75 THEN 'q3' ELSE 'q4_highest' END AS confidence_quartile
 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY text_path_confidence, sentence_id) AS rk, count(*) OVER (PARTITION BY {by}) AS nn FROM {source}))"""


PAIRS = """v_pair0 AS (SELECT a.text_mode, c.eeg_control AS control, a.seed, a.sentence_id, a.target, a.class_name, a.length_group, a.correct_without_eeg, a.text_path_confidence,
 a.prediction_with_eeg AS pa, c.prediction_with_eeg AS pc, a.correct_with_eeg AS ca, c.correct_with_eeg AS cc, a.correct_with_eeg - c.correct_with_eeg AS delta, (a.prediction_with_eeg = c.prediction_with_eeg)::INT AS prediction_agreement
 FROM v_diag a JOIN v_diag c ON a.text_mode = c.text_mode AND a.seed = c.seed AND a.sentence_id = c.sentence_id AND a.target = c.target WHERE a.eeg_control = 'aligned' AND c.eeg_control <> 'aligned'),
""" + quartile("text_mode, control, seed", "v_pair0", "v_pair")


def subsets(by: str, source: str, readers: bool = False) -> str:
    q = f"v_cut AS (SELECT {by}, seed, quantile_cont(text_path_confidence, 0.25) AS q25, quantile_cont(text_path_confidence, 0.5) AS q50 FROM {source} GROUP BY {by}, seed)"
    parts = [
        ("all", "'all'", "true", 1), ("text_difficulty", "'low_confidence_25'", "text_path_confidence <= q25", 1), ("text_difficulty", "'low_confidence_50'", "text_path_confidence <= q50", 1),
        ("text_difficulty", "'no_eeg_incorrect'", "correct_without_eeg = 0", 1), ("true_class", "class_name", "true", 0), ("sentence_length", "length_group", "true", 0), ("confidence_quartile", "confidence_quartile", "true", 0)]
    if readers:
        parts.append(("reader_count", "reader_count::VARCHAR", "true", 0))
    return q + f", v_in AS (SELECT x.*, q25, q50 FROM {source} x JOIN v_cut USING ({by}, seed)), v_sub AS (" + " UNION ALL ".join(f"SELECT *, '{t}' AS subset_type, {n} AS subset_name, {f} AS with_f1 FROM v_in WHERE {w}" for t, n, w, f in parts) + ")"


#: Hits, predictions and true counts by class from confusion counts, in the order of the engine's vectors.
SIDES = ", ".join([*(x for p in "xy" for x in (*(f"{p}{k}{k}" for k in range(3)), *(f"{p}0{k} + {p}1{k} + {p}2{k}" for k in range(3)))), *(f"x{k}0 + x{k}1 + x{k}2" for k in range(3))])

#: Every sentence in a place of its own.
BY_SENTENCE = f"{h(chr(39) + 'cluster' + chr(39), 'sentence_id')}, sentence_id"


def drawn(clusters: str, group: str, seed: int, name: str, order: str) -> str:
    """Bootstrap draws: every cluster column of ``clusters`` for each replicate."""
    names = [g.strip() for g in group.split(",")]
    p, a, b, c, d = 2147483647, 104729, 15485863, 48271, 40692
    return f"""{name}_placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS place, count(*) OVER (PARTITION BY {group}) AS nc, {h(str(seed), *names)} AS g, dense_rank() OVER (ORDER BY {group}) AS gid FROM {clusters}),
{name}_x1 AS (SELECT gid, nc, g, replicate, (g + replicate * {a} + place * {b}) % {p} AS x1 FROM {name}_placed, (SELECT unnest(range(1, {SAMPLES + 1})) AS replicate)),
{name}_x2 AS (SELECT *, (x1 * x1 + g) % {p} AS x2 FROM {name}_x1),
{name}_x3 AS (SELECT *, (x2 * x2 + x1 * {c}) % {p} AS x3 FROM {name}_x2),
{name}_asked AS (SELECT gid, replicate, (x3 * 2147483648 + (x3 * x3 + x2 * {d} + replicate) % {p}) % nc AS place FROM {name}_x3),
{name} AS (SELECT k.replicate, p.* FROM {name}_asked k JOIN {name}_placed p USING (gid, place))"""


def accuracy_ci(source: str, group: str, seed: int, sides: tuple[str, str] | None = None) -> str:
    cells = f", {confusion('target', sides[0], 'x')}, {confusion('target', sides[1], 'y')}" if sides else ""
    return f"""v_acc0 AS (SELECT {group}, sentence_id, sum(delta) AS s, count(delta) AS c{cells} FROM {source} GROUP BY {group}, sentence_id), {drawn('v_acc0', group, seed, 'v_accd', SIDES if sides else 's, c')},
v_acc AS (SELECT {group}, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM (SELECT {group}, replicate, sum(s)::DOUBLE / sum(c) AS d FROM v_accd GROUP BY ALL) GROUP BY {group})"""


def f1_ci(source: str, group: str, seed: int, a: str, b: str, present: bool, order: str = SIDES) -> str:
    cells = ", ".join(f"sum({p}{i}{j}) AS {p}{i}{j}" for p in "xy" for i in range(3) for j in range(3))
    return f"""v_f10 AS (SELECT {group}, sentence_id, {confusion('target', a, 'x')}, {confusion('target', b, 'y')} FROM {source} GROUP BY {group}, sentence_id), {drawn('v_f10', group, seed, 'v_f1d', order)},
v_f1 AS (SELECT {group}, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM (SELECT {group}, {macro('x', present)} - {macro('y', present)} AS d FROM (SELECT {group}, replicate, {cells} FROM v_f1d GROUP BY {group}, replicate)) GROUP BY {group}),
v_f1seen AS (SELECT {group}, {macro('x', present)} - {macro('y', present)} AS delta_macro_f1 FROM (SELECT {group}, {cells} FROM v_f10 GROUP BY {group}))"""


G3, G4 = "setup, subset_type, subset_name", "text_mode, control, subset_type, subset_name"
CONTRIBUTIONS = f"""{quartile('setup, seed', 'v_diag', 'v_dq')}, v_dd AS (SELECT *, correct_with_eeg - correct_without_eeg AS delta FROM v_dq), {subsets('setup', 'v_dd')}, {accuracy_ci('v_sub', G3, 20260724)},
v_seed AS (SELECT {G3}, count_if(d > 0) AS n_seeds_modality_better FROM (SELECT {G3}, seed, avg(delta) AS d FROM v_sub GROUP BY ALL) GROUP BY {G3}),
v_contrib AS (SELECT x.*, a.low AS delta_accuracy_ci95_low, a.high AS delta_accuracy_ci95_high, s.n_seeds_modality_better FROM
 (SELECT {G3}, any_value(text_mode) AS text_mode, any_value(eeg_control) AS eeg_control, count(DISTINCT sentence_id) AS n_sentences, count(*) AS n_seed_predictions, avg(correct_with_eeg) AS with_modality_accuracy, avg(correct_without_eeg) AS without_modality_accuracy,
 avg(delta) AS delta_accuracy, avg(prediction_changed) AS prediction_changed_rate, sum(favorable_flip) AS favorable_flip_count, sum(unfavorable_flip) AS unfavorable_flip_count FROM v_sub GROUP BY {G3}) x JOIN v_acc a USING ({G3}) JOIN v_seed s USING ({G3}))"""
COMPARISONS = f"""{PAIRS}, {subsets('text_mode, control', 'v_pair')}, """ + (COMPARED := f"""{accuracy_ci('v_sub', G4, 20260723, ('pa', 'pc'))}, v_subf AS (SELECT * FROM v_sub WHERE with_f1 = 1), {f1_ci('v_subf', G4, 20260723, 'pa', 'pc', False)},
v_seed AS (SELECT {G4}, avg(d) AS seed_delta_accuracy_mean, min(d) AS seed_delta_accuracy_min, max(d) AS seed_delta_accuracy_max, count_if(d > 0) AS n_seeds_aligned_better FROM (SELECT {G4}, seed, avg(delta) AS d FROM v_sub GROUP BY ALL) GROUP BY {G4}),
v_cmp AS (SELECT x.* EXCLUDE ({', '.join(f'{p}{i}{j}' for p in 'xy' for i in range(3) for j in range(3))}), {macro('x')} AS aligned_macro_f1, {macro('y')} AS control_macro_f1, {macro('x')} - {macro('y')} AS delta_macro_f1, a.low AS delta_accuracy_ci95_low, a.high AS delta_accuracy_ci95_high,
 f.low AS delta_macro_f1_ci95_low, f.high AS delta_macro_f1_ci95_high, s.* EXCLUDE ({G4}) FROM
 (SELECT {G4}, count(DISTINCT sentence_id) AS n_sentences, count(*) AS n_seed_predictions, avg(ca) AS aligned_accuracy, avg(cc) AS control_accuracy, avg(delta) AS delta_accuracy, avg(prediction_agreement) AS prediction_agreement,
 {confusion('target', 'pa', 'x')}, {confusion('target', 'pc', 'y')} FROM v_sub GROUP BY {G4}) x JOIN v_acc a USING ({G4}) LEFT JOIN v_f1 f USING ({G4}) JOIN v_seed s USING ({G4}))""")
READERS = "v_rc AS (SELECT sentence_id, count(DISTINCT subject) AS reader_count FROM v_aligned GROUP BY 1)"
READER_COMPARISONS = "v_diagr AS (SELECT d.*, r.reader_count FROM v_diag d JOIN v_rc r USING (sentence_id)), " + PAIRS.replace("a.length_group,", "a.length_group, a.reader_count,").replace("v_diag ", "v_diagr ") + f", {subsets('text_mode, control', 'v_pair', True)}, {COMPARED}"
PRIORITY = "('low_confidence_25', 'low_confidence_50', 'no_eeg_incorrect')"
DECISION = f"""SELECT *, (SELECT coalesce(bool_or(passed_all_controls), false) FROM v_dec) AS detected FROM v_dec"""
V_DEC = f"v_dec AS (SELECT text_mode, subset_name, (list_sort(list_distinct(list(control))) = ['noise', 'shuffled', 'zero']) AND bool_and(delta_accuracy >= 0.015 AND delta_accuracy_ci95_low > 0 AND n_seeds_aligned_better >= 2) AS passed_all_controls FROM v_cmp WHERE subset_name IN {PRIORITY} GROUP BY ALL)"

STAT_COLUMNS = ["mean", "std", "var", "min", "max", "ptp", "median", "iqr", "skew", "kurtosis", "rms", "mav", "line_length", "zcr", "hjorth_mobility", "hjorth_complexity"]
BANDS = ["t1", "t2", "a1", "a2", "b1", "b2", "g1", "g2"]
STATS = f"""{SAMPLES_V}, v_d1 AS (SELECT *, value - lag(value) OVER w AS d1, avg(value) OVER (PARTITION BY recording, channel) AS mu FROM v_samples WINDOW w AS (PARTITION BY recording, channel ORDER BY ts, event_id)),
v_d2 AS (SELECT *, d1 - lag(d1) OVER w AS d2, sign(coalesce(value - mu, 0)) AS sg FROM v_d1 WINDOW w AS (PARTITION BY recording, channel ORDER BY ts, event_id)),
v_d3 AS (SELECT *, (sg <> lag(sg) OVER (PARTITION BY recording, channel ORDER BY ts, event_id))::INT AS crossed FROM v_d2),
v_m AS (SELECT recording, channel, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS var, min(value) AS min, max(value) AS max, max(value) - min(value) AS ptp, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4, avg((value - mu) ** 2) AS m2, sqrt(avg(value * value)) AS rms, avg(abs(value)) AS mav,
 avg(abs(d1)) AS line_length, coalesce(sum(abs(d1)), 0) AS line_sum, coalesce(sum(crossed), 0)::DOUBLE / greatest(count(*) - 1, 1) AS zcr, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM v_d3 GROUP BY recording, channel),
v_stats0 AS (SELECT *, CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 END AS skew, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS kurtosis, sqrt(v1 / nullif(var, 0)) AS hjorth_mobility FROM v_m),
v_stats AS (SELECT *, sqrt(v2 / nullif(v1, 0)) / nullif(hjorth_mobility, 0) AS hjorth_complexity FROM v_stats0)"""
_MATRIX = " UNION ALL ".join(f"SELECT recording, channel, {i} AS fam, 'raw_{s}' AS family, {s} AS value FROM v_stats" for i, s in enumerate(STAT_COLUMNS))
_BAND = "SELECT user_id AS recording, event_type AS channel, 16 + event_id % 8 AS fam, 'bandmean_' || [" + ", ".join(f"'{b}'" for b in BANDS) + "][(event_id % 8 + 1)::INT] AS family, avg(value) AS value FROM events GROUP BY ALL"
_NAMES = "[" + ", ".join(f"'raw_{s}'" for s in STAT_COLUMNS) + ", " + ", ".join(f"'bandmean_{b}'" for b in BANDS) + "]"
ALIGNED = "v_al AS (SELECT f.sentence_id, f.subject, ((pos // 4) * 3 + pos % 4)::INT AS pos, f.value FROM v_features f WHERE pos % 4 <> 3), v_aligned AS (SELECT a.* FROM v_al a JOIN (SELECT sentence_id, subject FROM v_al GROUP BY ALL HAVING count(value) > 0) USING (sentence_id, subject))"

_GP = {"gate": 8, "pb": 8, "cb": 3}


def _vec(name: str, n: int, *key: str) -> str:
    return "[" + ", ".join(f"{u(chr(39) + name + chr(39), *key, str(i))} - 0.5::DOUBLE" for i in range(n)) + "]"


def _gated() -> str:
    def dots(matrix: str, rows: int, bias: str, x: str, n: int) -> str:
        return "[" + ", ".join(f"list_sum(list_transform(range(1, {n + 1}), lambda j: {matrix}{i}[j] * {x}[j])) + {bias}[{i + 1}]" for i in range(rows)) + "]"

    project = ", ".join(f"{_vec('project', 64, str(i))} AS w{i}" for i in range(8))
    classify = ", ".join(f"{_vec('classify', 8, str(i))} AS k{i}" for i in range(3))
    norm = lambda x: f"sqrt(list_sum(list_transform({x}, lambda v: v * v)))"
    text = "[" + ", ".join(u("'text'", "sentence_id", str(i)) for i in range(8)) + "]"
    return f"""WITH {FEATURES}, v_pool AS (SELECT sentence_id, pos, avg(coalesce(value, 0.0::DOUBLE)) AS value FROM v_features GROUP BY ALL),
v_sig AS (SELECT sentence_id, list(value ORDER BY pos) AS sig, {text} AS txt FROM v_pool GROUP BY sentence_id),
v_par AS MATERIALIZED (SELECT {_vec('gate', 8)} AS gate, {_vec('pb', 8)} AS pb, {_vec('cb', 3)} AS cb, {project}, {classify}),
v_lin AS (SELECT *, {dots('w', 8, 'pb', 'sig', 64)} AS lin FROM v_sig, v_par),
v_can AS (SELECT *, list_transform(range(1, 9), lambda j: lin[j] / (1.0 + exp(-gate[j]))) AS can FROM v_lin),
v_fus AS (SELECT *, list_transform(range(1, 9), lambda j: txt[j] + can[j]) AS fus FROM v_can),
v_log AS (SELECT *, {dots('k', 3, 'cb', 'fus', 8)} AS lw, {dots('k', 3, 'cb', 'txt', 8)} AS lo FROM v_fus)
SELECT sentence_id, {', '.join(f'{r(f"lw[{k + 1}]")} AS with_{k}, {r(f"lo[{k + 1}]")} AS without_{k}' for k in range(3))}, {r(norm('txt'))} AS text_embedding_norm, {r(norm('sig'))} AS eeg_embedding_norm,
 {r(norm('can'))} AS candidate_eeg_contribution_norm, {r(norm('can'))} AS gated_eeg_contribution_norm, {argmax('lo')} AS zero_prediction, 0.0::DOUBLE AS zero_norm FROM v_log"""


def build() -> dict[str, str]:
    diag_cols = ["text_path_confidence", "text_path_margin", "text_embedding_norm", "eeg_embedding_norm", "candidate_eeg_contribution_norm", "gated_eeg_contribution_norm", "contribution_to_text_norm_ratio", "logit_delta_l2"]
    metric_cols = ["accuracy", "macro_f1", "weighted_f1", "f1_0", "f1_1", "f1_2"]
    cells = [f"c{i}{j}" for i in range(3) for j in range(3)]
    norms = ["text_embedding_norm", "eeg_embedding_norm", "candidate_eeg_contribution_norm", "gated_eeg_contribution_norm", "logit_delta_l2"]
    fold_stats = ", ".join(f"{f}({c}) AS {c}_{n}" for c in norms for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    fold_cols = [f"{c}_{n}" for c in norms for n in ("mean", "std", "min", "max")]
    fdiag = f"v_fd AS (SELECT setup, seed, fold, {fold_stats}, sum(prediction_changed) AS changed_count, avg(prediction_changed) AS changed_rate, count(*) AS n_test FROM v_diag d JOIN v_fold f USING (sentence_id, seed) GROUP BY setup, seed, fold)"
    cmp_cols = ["aligned_accuracy", "control_accuracy", "delta_accuracy", "prediction_agreement", "aligned_macro_f1", "control_macro_f1", "delta_macro_f1", "delta_accuracy_ci95_low", "delta_accuracy_ci95_high", "delta_macro_f1_ci95_low", "delta_macro_f1_ci95_high", "seed_delta_accuracy_mean", "seed_delta_accuracy_min", "seed_delta_accuracy_max"]
    con_cols = ["with_modality_accuracy", "without_modality_accuracy", "delta_accuracy", "prediction_changed_rate", "delta_accuracy_ci95_low", "delta_accuracy_ci95_high"]
    rpt = f"""v_rp AS (SELECT a.text_mode, c.eeg_control AS control, a.seed, a.sentence_id, a.target, a.prediction AS pa, c.prediction AS pc FROM v_scored a JOIN v_scored c ON a.text_mode = c.text_mode AND a.seed = c.seed AND a.sentence_id = c.sentence_id AND a.target = c.target
 WHERE a.eeg_control = 'aligned' AND c.eeg_control <> 'aligned')"""
    base_logits = "[" + ", ".join(f"{u(chr(39) + 'b' + chr(39), 'sentence_id', 'seed', 'text_mode', str(k))} + CASE WHEN target = {k} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END" for k in range(3)) + "]"
    bp = f"""v_bl AS (SELECT l.sentence_id, l.sentiment_label + 1 AS target, s.seed, m.text_mode FROM v_labels l, {VALUES_SEED}, (VALUES ('finetune'), ('frozen')) m(text_mode)),
v_bpred AS (SELECT 'text_' || text_mode AS baseline, seed, sentence_id, target, {argmax('lg')} AS pb FROM (SELECT *, {base_logits} AS lg FROM v_bl)),
v_bpair AS (SELECT c.setup, b.baseline, c.seed, c.sentence_id, c.target, c.prediction AS pa, b.pb FROM v_scored c JOIN v_bpred b ON b.baseline = 'text_' || c.text_mode AND b.seed = c.seed AND b.sentence_id = c.sentence_id AND b.target = c.target)"""
    names = "(VALUES " + ", ".join(f"('{s}')" for s in ["text_frozen", "text_finetune", "eeg_only", "concat_frozen", "concat_finetune", "gated_frozen", "gated_finetune", "gated_shuffled_frozen", "gated_shuffled_finetune", "gated_noise_frozen", "gated_noise_finetune", "gated_zero_frozen", "gated_zero_finetune"]) + ") n(setup)"
    parsed = f"""v_setups AS (SELECT setup, CASE WHEN setup = 'eeg_only' THEN 'eeg' ELSE split_part(setup, '_', 1) END AS fusion, CASE WHEN setup = 'eeg_only' THEN 'none' WHEN suffix(setup, 'finetune') THEN 'finetune' ELSE 'frozen' END AS text_mode,
 CASE WHEN contains(setup, '_shuffled_') THEN 'shuffled' WHEN contains(setup, '_noise_') THEN 'noise' WHEN contains(setup, '_zero_') THEN 'zero' ELSE 'aligned' END AS eeg_control FROM {names})"""
    rows_al = "v_rows AS (SELECT s.seed, s.fold, s.split, s.sentence_id, f.subject, f.pos, f.value FROM v_split s JOIN v_features f ON s.sentence_id = f.sentence_id)"
    rows_sh = f"{PERMUTATION}, v_rows AS (SELECT s.seed, s.fold, s.split, s.sentence_id, f.subject, f.pos, f.value FROM v_perm s JOIN v_features f ON s.source_id = f.sentence_id)"
    noise = f"sqrt(-2.0::DOUBLE * ln({u(chr(39) + 'a' + chr(39), 'seed', 'fold', 'sentence_id', 'subject', 'pos')})) * cos(2.0::DOUBLE * pi() * {u(chr(39) + 'b' + chr(39), 'seed', 'fold', 'sentence_id', 'subject', 'pos')})"
    best = f"""WITH RECURSIVE {BASE}, {BY_FOLD}, v_run AS (SELECT DISTINCT concat_ws('/', setup, seed, fold) AS run FROM v_byfold),
v_hist AS (SELECT run, e::INT AS epoch, {u("'f1'", 'run', 'e')} AS f1 FROM v_run, (SELECT unnest(range(1, 13)) AS e)),
v_st AS (SELECT run, 0 AS epoch, -1.0::DOUBLE AS best, 0 AS besta, 0 AS bad FROM v_run UNION ALL
 SELECT s.run, h.epoch, CASE WHEN h.f1 > s.best + 1e-8 THEN h.f1 ELSE s.best END, CASE WHEN h.f1 > s.best + 1e-8 THEN h.epoch ELSE s.besta END, CASE WHEN h.f1 > s.best + 1e-8 THEN 0 ELSE s.bad + 1 END FROM v_st s JOIN v_hist h ON h.run = s.run AND h.epoch = s.epoch + 1 WHERE s.bad < 4)
SELECT run, arg_max(besta, epoch) AS best_epoch, {r('arg_max(best, epoch)')} AS best_f1, max(epoch) AS stopped_at FROM v_st GROUP BY run"""
    flips = "v_flip AS (SELECT setup, text_mode, eeg_control, count(DISTINCT seed) AS n_seeds, count(*) AS n_predictions, sum(prediction_changed) AS prediction_changed_count, avg(prediction_changed) AS prediction_changed_rate, sum(favorable_flip) AS favorable_flip_count, sum(unfavorable_flip) AS unfavorable_flip_count, sum(correct_with_eeg) - sum(correct_without_eeg) AS net_correct_change, avg(logit_delta_l2) AS logit_delta_l2_mean, avg(contribution_to_text_norm_ratio) AS contribution_to_text_norm_ratio_mean FROM v_diag GROUP BY ALL)"

    def star(source: str, rounded: list[str], drop: str = "") -> str:
        return f"SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in rounded)}){drop} FROM {source}"

    findings = f"""WITH {DIAGNOSTICS}, v_a AS (WITH {COMPARISONS} SELECT * FROM v_cmp), v_b AS (WITH {CONTRIBUTIONS} SELECT * FROM v_contrib), {flips}
SELECT section, text_mode, what, {r('value')} AS value FROM (SELECT 'all' AS section, text_mode, control AS what, delta_accuracy AS value FROM v_a WHERE subset_name = 'all' UNION ALL
 SELECT 'priority', text_mode, control || '|' || subset_name, delta_accuracy FROM v_a WHERE subset_name IN {PRIORITY} UNION ALL
 SELECT 'contribution', text_mode, subset_name, delta_accuracy FROM v_b WHERE eeg_control = 'aligned' AND (subset_name = 'all' OR subset_name IN {PRIORITY}) UNION ALL
 SELECT 'flips', text_mode, setup, net_correct_change FROM v_flip WHERE eeg_control = 'aligned')"""
    out = {
        "labels_scan": f"WITH {LABELS} SELECT sentence_id, md5({NORM.format('sentence')}) AS norm_md5, {WORDS.format('sentence')} AS word_count, sentiment_label + 1 AS target, ['negative', 'neutral', 'positive'][sentiment_label + 2] AS class_name FROM v_labels",
        "label_lookup": f"WITH {LABELS} SELECT md5({NORM.format('sentence')}) AS norm_md5, max(sentence_id) AS sentence_id, arg_max(sentiment_label, sentence_id) AS sentiment_label FROM v_labels GROUP BY {NORM.format('sentence')}",
        "recording_match": f"WITH {LABELS}, k AS (SELECT {NORM.format('sentence')} AS t, max(sentence_id) AS sentence_id, arg_max(sentiment_label, sentence_id) AS sentiment_label FROM v_labels GROUP BY 1) SELECT d.doc_id AS recording, k.sentence_id, k.sentiment_label FROM documents d JOIN k ON {NORM.format('d.text')} = k.t",
        "sentence_metadata": f"WITH {LABELS}, {META} SELECT * FROM v_meta",
        "signal_statistics": f"WITH {STATS} SELECT recording, channel, {cols(*STAT_COLUMNS)} FROM v_stats",
        "line_length_sum": f"WITH {STATS} SELECT recording, channel, {r('line_sum')} AS line_length FROM v_stats",
        "channel_layout": "SELECT user_id AS recording, count(DISTINCT event_type) AS n_channels FROM events GROUP BY 1",
        "feature_matrix": f"""WITH {STATS}, v_chan AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS number FROM (SELECT DISTINCT event_type AS channel FROM events)), v_n AS (SELECT count(*) AS n FROM v_chan), v_all AS ({_MATRIX} UNION ALL {_BAND}),
v_val AS (SELECT v.* FROM v_all v JOIN (SELECT recording, fam >= 16 AS band, CASE WHEN fam >= 16 THEN fam END AS b FROM v_all GROUP BY ALL HAVING count(DISTINCT channel) = (SELECT n FROM v_n)) w ON v.recording = w.recording AND (v.fam >= 16) = w.band AND (CASE WHEN v.fam >= 16 THEN v.fam END) IS NOT DISTINCT FROM w.b),
v_dim AS (SELECT r.recording, (f.fam * c.n + k.number)::INT AS pos, {_NAMES}[f.fam + 1] || '_ch' || k.number AS name, f.fam, k.channel FROM (SELECT DISTINCT user_id AS recording FROM events) r, (SELECT unnest(range(24)) AS fam) f, v_chan k, (SELECT count(*) AS n FROM v_chan) c)
SELECT d.recording, d.pos, d.name, {r('v.value')} AS value FROM v_dim d LEFT JOIN v_val v ON d.recording = v.recording AND d.fam = v.fam AND d.channel = v.channel""",
        "aligned_features": f"WITH {FEATURES}, {ALIGNED} SELECT sentence_id, subject, pos, {r('value')} AS value FROM v_aligned",
        "data_summary": f"""WITH {FEATURES}, {ALIGNED}, b AS (SELECT pos, count(value) AS seen FROM v_aligned GROUP BY pos), q AS (SELECT sentence_id, count(DISTINCT subject) AS c FROM v_aligned GROUP BY 1)
SELECT (SELECT count(*) FROM b) AS n_features, (SELECT count(*) FROM b WHERE seen = 0) AS n_globally_all_missing_features, coalesce((SELECT string_agg('raw_' || {STAT_COLUMNS}[(pos // 3 + 1)::INT] || '_ch' || pos % 3, ',' ORDER BY pos) FROM b WHERE seen = 0), '') AS all_missing,
 16 AS n_dropped_reference_features, (SELECT string_agg('raw_' || {STAT_COLUMNS}[i::INT] || '_ch3', ',' ORDER BY i) FROM (SELECT unnest(range(1, 17)) AS i)) AS dropped_reference_features,
 sum(c) AS usable_subject_sentence_rows, min(c) AS subjects_per_sentence_min, max(c) AS subjects_per_sentence_max, round(avg(c), 6) AS subjects_per_sentence_mean, (SELECT count(*) FROM v_flabels) AS n_sentences,
 (SELECT count(*) FROM v_flabels WHERE sentiment_label = -1) AS negative, (SELECT count(*) FROM v_flabels WHERE sentiment_label = 0) AS neutral, (SELECT count(*) FROM v_flabels WHERE sentiment_label = 1) AS positive,
 (SELECT count(DISTINCT subject) FROM v_aligned) AS n_subjects, (SELECT count(*) FROM b) // 16 AS n_channels, 16 AS n_feature_families FROM q""",
        "reader_counts": f"WITH {FEATURES}, {ALIGNED} SELECT sentence_id, count(DISTINCT subject) AS reader_count FROM v_aligned GROUP BY 1",
        "setup_grid": f"WITH {LABELS}, {folds('v_labels')}, {parsed} SELECT p.*, f.seed, f.fold, f.seed + 1000 * f.fold AS fold_seed, fusion <> 'eeg' AS uses_text, fusion <> 'text' AS uses_eeg, fusion = 'gated' AND eeg_control = 'zero' AS zero_eeg_contribution FROM v_setups p, (SELECT DISTINCT seed, fold FROM v_fold) f",
        "fold_assignment": f"WITH {LABELS}, {folds('v_labels')} SELECT * FROM v_fold",
        "split_assignment": f"WITH {LABELS}, {folds('v_labels')}, {SPLITS} SELECT * FROM v_split",
        "shuffled_control": f"WITH {FEATURE_SPLITS}, {PERMUTATION} SELECT * FROM v_perm",
        "noise_control": f"WITH {FEATURE_SPLITS}, {rows_al} SELECT seed, fold, split, sentence_id, subject, pos, {r(noise)} AS value FROM v_rows",
        "fold_preprocessing": f"WITH {FEATURE_SPLITS}, {rows_al}, {fit('v_rows')} SELECT seed, fold, pos, observed, {cols('median', 'mean', 'std')} FROM v_fit",
        "shuffled_transform": f"WITH {FEATURE_SPLITS}, {rows_sh}, {fit('v_rows')} SELECT t.seed, t.fold, t.split, t.sentence_id, t.subject, t.pos, {r('CASE WHEN f.observed THEN (coalesce(t.value, f.median) - f.mean) / f.std ELSE 0.0 END')} AS value FROM v_rows t JOIN v_fit f USING (seed, fold, pos)",
        "experiment_predictions": f"WITH {FEATURES}, v_have AS (SELECT f.* FROM v_flabels f JOIN documents d ON d.doc_id = f.sentence_id), {folds('v_have', '(VALUES (42)) s(seed)')} SELECT 'gated_frozen' AS setup, seed, fold, sentence_id, sentiment_label + 1 AS target, true AS fits_logits, true AS parts_add_up FROM v_fold",
        "pooled_features": f"WITH {FEATURES} SELECT sentence_id, pos, {r('avg(value)')} AS value FROM v_features GROUP BY ALL",
        "classification_metrics": f"WITH {BASE}, {metrics('setup, seed')} SELECT setup, seed, n, {', '.join(cells)}, {cols(*metric_cols)} FROM v_metrics",
        "log_loss": f"WITH {BASE} SELECT setup, seed, {r('avg(-ln(exp(wi[target + 1] - list_max(wi)) / (exp(wi[1] - list_max(wi)) + exp(wi[2] - list_max(wi)) + exp(wi[3] - list_max(wi)))))')} AS loss FROM v_scored GROUP BY ALL",
        "fold_summary": f"WITH {BASE}, {BY_FOLD}, {metrics('setup, seed, fold', 'v_byfold')} SELECT setup, seed, {r('avg(accuracy)')} AS fold_accuracy_mean, {r('stddev_pop(accuracy)')} AS fold_accuracy_std, {r('avg(macro_f1)')} AS fold_macro_f1_mean, {r('stddev_pop(macro_f1)')} AS fold_macro_f1_std FROM v_metrics GROUP BY setup, seed",
        "seed_summary": f"WITH {BASE}, {BY_FOLD}, {GATES}, {metrics('setup, seed')}, g AS (SELECT setup, avg(m) AS gate_mean FROM (SELECT setup, seed, fold, avg(gate) AS m FROM v_gates GROUP BY ALL) GROUP BY setup) SELECT setup, count(*) AS n_seeds, {r('avg(accuracy)')} AS accuracy_mean, {r('stddev_pop(accuracy)')} AS accuracy_std, {r('avg(macro_f1)')} AS macro_f1_mean, {r('stddev_pop(macro_f1)')} AS macro_f1_std, {r('any_value(gate_mean)')} AS gate_mean FROM v_metrics JOIN g USING (setup) GROUP BY setup",
        "sentence_diagnostics": f"WITH {DIAGNOSTICS} {star('v_diag', diag_cols)}",
        "flip_summary": f"WITH {DIAGNOSTICS}, {flips} {star('v_flip', ['prediction_changed_rate', 'logit_delta_l2_mean', 'contribution_to_text_norm_ratio_mean'])}",
        "fold_diagnostics": f"WITH {DIAGNOSTICS}, {folds('v_labels')}, {fdiag} {star('v_fd', [*fold_cols, 'changed_rate'])}",
        "setup_diagnostics": f"""WITH {DIAGNOSTICS}, {BY_FOLD}, {GATES}, {fdiag}, g AS (SELECT setup, avg(gate) AS gate_mean, min(gate) AS gate_min, max(gate) AS gate_max FROM v_gates GROUP BY setup)
SELECT setup, n_seeds, {cols(*(f'{c}_mean' for c in norms), 'prediction_changed_without_eeg_rate', 'gate_mean', 'gate_min', 'gate_max')}, {r('candidate_eeg_contribution_norm_mean / greatest(text_embedding_norm_mean, 1e-12)')} AS candidate_to_text_norm_ratio, {r('gated_eeg_contribution_norm_mean / greatest(text_embedding_norm_mean, 1e-12)')} AS effective_to_text_norm_ratio
 FROM (SELECT setup, count(DISTINCT seed) AS n_seeds, {', '.join(f'avg({c}_mean) AS {c}_mean' for c in norms)}, sum(changed_count)::DOUBLE / greatest(sum(n_test), 1) AS prediction_changed_without_eeg_rate FROM v_fd GROUP BY setup) JOIN g USING (setup)""",
        "confidence_quartiles": f"WITH {DIAGNOSTICS}, {quartile('text_mode, eeg_control, seed', 'v_diag', 'v_q')} SELECT setup, seed, sentence_id, confidence_quartile FROM v_q",
        "paired_predictions": f"WITH {DIAGNOSTICS}, {PAIRS} SELECT text_mode, control, seed, sentence_id, target, pa AS prediction_with_eeg_aligned, pc AS prediction_with_eeg_control, delta, prediction_agreement, confidence_quartile FROM v_pair",
        "contribution_comparisons": f"WITH {DIAGNOSTICS}, {CONTRIBUTIONS} {star('v_contrib', con_cols)}",
        "subset_comparisons": f"WITH {DIAGNOSTICS}, {COMPARISONS} {star('v_cmp', cmp_cols)}",
        "stop_decision": f"WITH {DIAGNOSTICS}, {COMPARISONS}, {V_DEC} {DECISION}",
        "chart_rows": f"WITH {DIAGNOSTICS}, {COMPARISONS} SELECT text_mode, control, subset_name, {r('delta_accuracy', 4)} AS bar, {r('greatest(0.0, delta_accuracy - delta_accuracy_ci95_low)', 4)} AS error_low, {r('greatest(0.0, delta_accuracy_ci95_high - delta_accuracy)', 4)} AS error_high FROM v_cmp WHERE subset_name = 'all' OR subset_name IN {PRIORITY}",
        "report_findings": findings,
        "control_report": f"""WITH {BASE}, {rpt}, {f1_ci('v_rp', 'text_mode, control, seed', 42, 'pa', 'pc', True)}, {metrics('text_mode, control, seed', '(SELECT *, pa AS prediction FROM v_rp)', 'v_ma')}, {metrics('text_mode, control, seed', '(SELECT *, pc AS prediction FROM v_rp)', 'v_mc')},
ag AS (SELECT text_mode, control, seed, avg((pa = pc)::INT) AS agreement FROM v_rp GROUP BY ALL)
SELECT text_mode, control, count(*) AS n_seeds, {r('avg(a.macro_f1)')} AS aligned_macro_f1_mean, {r('avg(c.macro_f1)')} AS control_macro_f1_mean, {r('avg(s.delta_macro_f1)')} AS delta_aligned_minus_control, {r('avg(f.low)')} AS delta_ci95_low, {r('avg(f.high)')} AS delta_ci95_high, {r('avg(agreement)')} AS prediction_agreement_mean
 FROM v_f1 f JOIN v_f1seen s USING (text_mode, control, seed) JOIN v_ma a USING (text_mode, control, seed) JOIN v_mc c USING (text_mode, control, seed) JOIN ag USING (text_mode, control, seed) GROUP BY text_mode, control""",
        "baseline_delta": f"WITH {BASE}, {bp}, {f1_ci('v_bpair', 'setup, baseline, seed', 42, 'pa', 'pb', True, BY_SENTENCE)} SELECT setup, baseline, count(*) AS n_seeds, {r('avg(delta_macro_f1)')} AS delta_macro_f1, {r('avg(low)')} AS delta_ci95_low, {r('avg(high)')} AS delta_ci95_high FROM v_f1 JOIN v_f1seen USING (setup, baseline, seed) GROUP BY setup, baseline",
        "initialization_audit": f"WITH {BASE}, {BY_FOLD}, x AS (SELECT DISTINCT setup, text_mode, seed, fold, sha256('head.biasfloat32(3,)' || concat_ws('|', text_mode, seed, fold) || 'head.weightfloat32(3,)' || concat_ws('|', text_mode, seed, fold)) AS s FROM v_byfold) SELECT text_mode, seed, fold, count(DISTINCT setup) AS n_setups, count(DISTINCT s) = 1 AS matched FROM x GROUP BY ALL HAVING count(DISTINCT setup) >= 2",
        "parameter_fingerprints": f"WITH {BASE}, {BY_FOLD} SELECT DISTINCT setup, seed, fold, sha256('afloat32(2, 2)' || seed || '|' || fold || 'bfloat32(2, 2)' || seed || '|' || fold) AS task_sha256 FROM v_byfold",
        "mean_confusion": f"WITH {BASE}, {metrics('setup, seed')}, x AS ({' UNION ALL '.join(f'SELECT setup, {i} AS true, {j} AS predicted, avg(c{i}{j}) AS mean_count FROM v_metrics GROUP BY setup' for i in range(3) for j in range(3))}) SELECT setup, x.true, predicted, {r('mean_count')} AS mean_count, {r('mean_count / greatest(sum(mean_count) OVER (PARTITION BY setup, x.true), 1.0)')} AS share FROM x".replace(" AS true,", ' AS "true",').replace("x.true", 'x."true"'),
        "best_epochs": best,
        "run_completeness": f"WITH {BASE} SELECT text_mode, count(*) AS n_setups, count(DISTINCT seeds) = 1 AS matched FROM (SELECT text_mode, setup, string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) AS seeds FROM v_pred GROUP BY ALL) GROUP BY text_mode",
        "pending_runs": f"WITH {BASE}, {parsed} SELECT p.setup, s.seed FROM v_setups p, {VALUES_SEED} WHERE NOT EXISTS (SELECT 1 FROM v_pred q WHERE q.setup = p.setup AND q.seed = s.seed)",
        "run_manifest": f"WITH {BASE} SELECT 5 AS n_folds, (SELECT string_agg(setup, ',' ORDER BY setup) FROM (SELECT DISTINCT setup FROM v_pred)) AS setups, (SELECT string_agg(seed::VARCHAR, ',' ORDER BY seed) FROM (SELECT DISTINCT seed FROM v_pred)) AS seeds",
        "extraction_manifest": f"WITH {FEATURES} SELECT count(*) AS n_subjects, (SELECT count(DISTINCT pos) FROM v_features) AS n_features, 'normalized' AS line_length, string_agg(subject || ':' || n, ',' ORDER BY subject) AS subjects FROM (SELECT subject, count(DISTINCT sentence_id) AS n FROM v_features GROUP BY 1)",
        "gated_scoring": _gated(),
        "metadata_with_readers": f"WITH {LABELS}, {META}, {EVERY_FEATURE}, {ALIGNED}, {READERS} SELECT v_meta.*, reader_count FROM v_meta JOIN v_rc USING (sentence_id)",
        "subject_layouts": "SELECT recording % 7 AS subject, arg_min(n, recording) AS n_channels FROM (SELECT user_id AS recording, count(DISTINCT event_type) AS n FROM events GROUP BY 1) GROUP BY 1",
        "subject_ids": """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/d/results' || regexp_replace(source, '[^A-Za-z0-9]', '', 'g') || doc_id || '_SR.x.mat' WHEN 1 THEN '/d/results' || source || '-' || doc_id || '_SR.mat'
 WHEN 2 THEN '/d/resultsP' || doc_id || '_SR.parquet/part-00000-a.parquet' WHEN 3 THEN '/d/my_results' || doc_id || '.mat' ELSE '/d/S' || doc_id || '.h5/part-00001-b.parquet' END AS path FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(path, 'results[A-Za-z0-9]+_SR') THEN regexp_extract(path, 'results([A-Za-z0-9]+)_SR', 1) ELSE replace(replace(list_last(list_filter(string_split(path, '/'), lambda x: NOT regexp_matches(x, '^part-[0-9]{5}-'))), 'results', ''), '_SR.mat', '') END AS subject FROM p""",
        "run_tags": "SELECT event_id, strftime(ts, 'run_%Y%m%d_%H%M%S') AS tag FROM events",
        "labels_from_csv": f"WITH {LABELS} SELECT sentence_id, md5({NORM.format('sentence')}) AS norm_md5, sentiment_label FROM v_labels",
        "features_from_cache": f"WITH {FEATURES} SELECT sentence_id, subject, pos, {r('value')} AS value FROM v_features",
        "reader_subsets": f"WITH {DIAGNOSTICS}, {FEATURES}, {ALIGNED}, {READERS}, {READER_COMPARISONS} {star('v_cmp', cmp_cols)} WHERE subset_type = 'reader_count'",
        "score_chart": f"WITH {BASE}, {metrics('setup, seed')}, x AS (SELECT setup, avg(accuracy) AS am, stddev_pop(accuracy) AS asd, avg(macro_f1) AS fm, stddev_pop(macro_f1) AS fsd FROM v_metrics GROUP BY setup) SELECT setup, 'accuracy' AS metric, round(am, 4) AS bar, round(asd, 4) AS error FROM x UNION ALL SELECT setup, 'macro_f1', round(fm, 4), round(fsd, 4) FROM x",
        "flip_chart": f"WITH {DIAGNOSTICS}, {flips} SELECT setup, 'favorable' AS kind, favorable_flip_count AS bar FROM v_flip UNION ALL SELECT setup, 'unfavorable', -unfavorable_flip_count FROM v_flip",
        "predictions_from_files": f"WITH {BASE}, {BY_FOLD}, {metrics('setup, seed')}, {metrics('setup, seed, fold', 'v_byfold', 'v_mf')}, x AS (SELECT setup, seed, count(*) AS n_folds, avg(accuracy) AS fold_accuracy_mean FROM v_mf GROUP BY ALL) SELECT setup, seed, n, {r('macro_f1')} AS macro_f1, n_folds, {r('fold_accuracy_mean')} AS fold_accuracy_mean FROM v_metrics JOIN x USING (setup, seed)",
    }
    return out | {f"{name}_from_files": out[name] for name in ("seed_summary", "setup_diagnostics", "mean_confusion")}
