"""The same queries as plain SQL over the tables, for checking against another engine."""

from __future__ import annotations

# The characters that separate words, spelled out.
WHITESPACE = (
    r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _words(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WHITESPACE}'), lambda w: w <> '')"


def _hash(salt: str, identity: str = "id") -> str:
    return f"('0x' || substr(md5('{salt}:' || {identity}), 1, 8))::BIGINT"


def _exact(table: str, source: str) -> str:
    """Common table expressions that split ``source`` into ``table``: 10 percent, twice."""
    return f"""
    {table}_h AS (
        SELECT *, {_hash('test:42')} AS h_test, {_hash('val:42')} AS h_val FROM {source}),
    {table}_t AS (
        SELECT *, row_number() OVER (ORDER BY h_test, id) <= ceil(0.1::DECIMAL(9, 6) * count(*) OVER ()) AS in_test
        FROM {table}_h),
    {table} AS (
        SELECT *, CASE WHEN in_test THEN 'test'
            WHEN row_number() OVER (PARTITION BY in_test ORDER BY h_val, id)
                 <= ceil(0.1::DECIMAL(9, 6) * count(*) OVER (PARTITION BY in_test)) THEN 'validation'
            ELSE 'train' END AS split
        FROM {table}_t)"""


_DS = """
    ds AS (
        SELECT doc_id AS id, text, lang, source, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS label
        FROM documents)"""
_SPLIT = f"{_DS}, {_exact('ds_split', 'ds')}"
_TOKENS = f"""{_SPLIT},
    tok AS (
        SELECT id, split, label, lang, source, unnest({_words()}) AS token,
               generate_subscripts({_words()}, 1) AS pos
        FROM ds_split)"""
_VOCAB = f"""{_TOKENS},
    vocab AS (
        SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 1)::BIGINT AS token_id
        FROM (SELECT token, count(*) AS n FROM tok WHERE split = 'train' GROUP BY token))"""
_ENCODED = f"""{_VOCAB},
    enc AS (
        SELECT ds.id, ds.lang, coalesce(e.ids, []::BIGINT[]) AS ids
        FROM ds LEFT JOIN (
            SELECT id, list(coalesce(token_id, 1) ORDER BY pos) AS ids
            FROM tok LEFT JOIN vocab USING (token) GROUP BY id) e ON ds.id = e.id),
    fixed AS (
        SELECT id, list_transform(range(1, 129), lambda i: coalesce(ids[i], 0)) AS ids FROM enc),
    padded AS (
        SELECT id, lang, len(ids) AS n_valid, list_transform(
            range(1, 1 + 128 * greatest(1, ceil(len(ids) / 128)::BIGINT)), lambda i: coalesce(ids[i], 0)) AS ids
        FROM enc)"""
_UNIGRAM = f"""{_TOKENS},
    seen AS (SELECT token, count(*) AS c FROM tok WHERE split = 'train' GROUP BY token),
    size AS (SELECT sum(c) + count(*) + 1 AS d FROM seen),
    scored AS (
        SELECT tok.*, -ln((coalesce(c, 0) + 1) / d::DOUBLE) AS nll
        FROM tok LEFT JOIN seen USING (token), size WHERE split <> 'train')"""
_PRED = "pred AS (SELECT doc_id AS id, quality AS label, 1 - toxic AS prediction FROM labels)"


def _metrics(source: str, by: str = "") -> str:
    """Tables ``per_class`` and ``summary`` from the predictions in ``source``."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    roles AS (
        SELECT {key}label AS class, 1 AS support, 0 AS predicted, (label = prediction)::INTEGER AS tp FROM {source}
        UNION ALL SELECT {key}prediction, 0, 1, 0 FROM {source}),
    counts AS (
        SELECT {key}class AS label, sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted,
               sum(support)::BIGINT AS support
        FROM roles GROUP BY {key}class),
    per_class AS (
        SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall,
               CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (predicted + support) END AS f1
        FROM counts),
    summary AS (
        SELECT {key}round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
               round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
               round(sum(precision * support) / sum(support), 6) AS precision_weighted,
               round(sum(recall * support) / sum(support), 6) AS recall_weighted,
               round(sum(f1 * support) / sum(support), 6) AS f1_weighted
        FROM per_class {group})"""


_LOGITS = """
    emb AS (
        SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, vec_id // 32 AS batch_id FROM embeddings),
    lse AS (
        SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS log_total FROM emb),
    losses AS (
        SELECT *, log_total - x[label + 1] AS nll, log_total - list_avg(x) AS mean_nll,
               list_position(x, list_max(x)) - 1 AS prediction
        FROM lse)"""
_HIST = """
    hist AS (
        SELECT user_id AS run_id, value AS val_f1,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS epoch
        FROM events)"""
_STREAK = f"""{_HIST},
    earlier AS (
        SELECT *, greatest(0, coalesce(max(val_f1) OVER (
                PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best
        FROM hist),
    improved AS (SELECT *, val_f1 > best AS improved FROM earlier),
    streaks AS (
        SELECT run_id, epoch, val_f1, improved,
               (epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (
                PARTITION BY run_id ORDER BY epoch), 0))::INTEGER AS streak
        FROM improved)"""
_PAIR = """
    days AS (
        SELECT user_id AS run_id, ts::DATE AS day,
               round(avg(CASE WHEN event_type <> 'view' THEN value END), 6) AS train_acc,
               round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS val_acc
        FROM events GROUP BY user_id, ts::DATE),
    pair AS (
        SELECT run_id, train_acc, val_acc, row_number() OVER (PARTITION BY run_id ORDER BY day)::INTEGER AS epoch
        FROM days)"""
_RUNS = """
    runs AS (
        SELECT event_type AS run_id, 'all' AS dataset, round(sum(value) / 60, 6) AS training_time_minutes,
               round(avg(value) / 100, 6) AS f1_macro, count(*) AS epochs,
               count(DISTINCT user_id) AS trainable_parameters, count(*) AS total_parameters
        FROM events GROUP BY event_type)"""
_CLASSES = """
    classes AS (SELECT label, count(*) AS docs FROM ds_split WHERE split = 'train' GROUP BY label),
    words AS (SELECT id, split, label, token, count(*) AS n FROM tok GROUP BY ALL),
    per_doc AS (SELECT id, sum(n) AS total FROM words GROUP BY id),
    train_tokens AS (SELECT DISTINCT token FROM words WHERE split = 'train')"""
_KEYWORDS = """
    class_tokens AS (SELECT label, token, sum(n) AS n FROM words WHERE split = 'train' GROUP BY ALL),
    class_sizes AS (
        SELECT c.label, ln(docs / (SELECT sum(docs) FROM classes)) AS prior,
               (SELECT coalesce(sum(n), 0) FROM class_tokens t WHERE t.label = c.label)
               + (SELECT count(*) FROM train_tokens) AS total
        FROM classes c),
    likelihood AS (
        SELECT c.label, t.token, ln((coalesce(ct.n, 0) + 1) / c.total) AS lp
        FROM train_tokens t CROSS JOIN class_sizes c
        LEFT JOIN class_tokens ct ON ct.label = c.label AND ct.token = t.token),
    keyword_sums AS (
        SELECT w.id, l.label AS class, sum(w.n * l.lp) AS s
        FROM words w JOIN likelihood l USING (token) GROUP BY w.id, l.label),
    keyword_scores AS (
        SELECT d.id, d.split, d.label, c.label AS class, c.prior + coalesce(s, 0) AS raw, round(raw, 6) AS score
        FROM ds_split d CROSS JOIN class_sizes c
        LEFT JOIN keyword_sums k ON k.id = d.id AND k.class = c.label),
    keyword_best AS (
        SELECT id, split, label, class AS prediction, raw FROM keyword_scores
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1)"""
_CENTROIDS = """
    text_centroids AS (
        SELECT w.label, token, sum(n / total::DOUBLE) / any_value(docs) AS mean
        FROM words w JOIN per_doc USING (id) JOIN classes c ON c.label = w.label
        WHERE split = 'train' GROUP BY w.label, token),
    text_bias AS (
        SELECT c.label, coalesce(-0.5 * sum(mean * mean), 0) AS bias
        FROM classes c LEFT JOIN text_centroids t ON t.label = c.label GROUP BY c.label),
    centroid_sums AS (
        SELECT w.id, t.label AS class, sum(w.n / total::DOUBLE * mean) AS s
        FROM words w JOIN per_doc USING (id) JOIN text_centroids t USING (token) GROUP BY w.id, t.label),
    centroid_scores AS (
        SELECT d.id, d.split, d.label, c.label AS class, round(bias + coalesce(s, 0), 6) AS score
        FROM ds_split d CROSS JOIN text_bias c
        LEFT JOIN centroid_sums k ON k.id = d.id AND k.class = c.label),
    centroid_best AS (
        SELECT id, split, label, class AS prediction, score FROM centroid_scores
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1)"""
_STATS = """
    round(avg(n), 6) AS avg_words, min(n)::INTEGER AS min_words, max(n)::INTEGER AS max_words,
    least(512, trunc(avg(n) * 2))::INTEGER AS recommended_max_seq_length"""

# Candidates of a training run: L2 penalty, step size, steps.
_ONE = [(0.0001, 12.0, 5)]
_GRID = [(0.01, 4.0, 2), (0.001, 12.0, 4), (0.0, 12.0, 5)]


def _descent(candidates: list[tuple]) -> str:
    """Gradient descent from zero on the tokens ``tok`` of ``ds_split``, one table of logits ``z_<step>`` after each step."""
    values = ", ".join(f"({i}, {l2}::DOUBLE, {rate}::DOUBLE, {n})" for i, (l2, rate, n) in enumerate(candidates, start=1))
    steps = max(c[-1] for c in candidates)
    parts = [
        f"""cand AS (SELECT * FROM (VALUES {values}) AS t(c, l2, rate, steps)),
        kinds AS (SELECT DISTINCT label AS k FROM ds_split WHERE split = 'train'),
        counted AS (SELECT id, token, count(*) AS n FROM tok GROUP BY id, token),
        design AS MATERIALIZED (
            SELECT id, token, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM counted
            UNION ALL SELECT id, '', 1.0 FROM ds_split),
        z_0 AS (SELECT c, id, split, label, k, 0.0::DOUBLE AS z FROM ds_split, kinds, cand),
        w_0 AS (SELECT NULL::INTEGER AS c, ''::VARCHAR AS token, NULL::INTEGER AS k, 0.0::DOUBLE AS w WHERE FALSE),
        n_train AS (SELECT count(*) AS n FROM ds_split WHERE split = 'train')"""
    ]
    for s in range(1, steps + 1):
        parts.append(f"""
        e_{s} AS (
            SELECT c, id, k, label, exp(z - max(z) OVER (PARTITION BY c, id)) AS e FROM z_{s - 1} WHERE split = 'train'),
        r_{s} AS MATERIALIZED (
            SELECT c, id, k, e / sum(e) OVER (PARTITION BY c, id) - CASE WHEN k = label THEN 1 ELSE 0 END AS r FROM e_{s}),
        g_{s} AS (
            SELECT c, token, k, sum(x * r) / any_value(n) AS g FROM design JOIN r_{s} USING (id), n_train
            GROUP BY c, token, k),
        w_{s} AS MATERIALIZED (
            SELECT g.c, g.token, g.k, CASE WHEN {s} <= steps
                THEN coalesce(w, 0) - rate * (g + CASE WHEN g.token = '' THEN 0 ELSE l2 * coalesce(w, 0) END) ELSE w END AS w
            FROM g_{s} g JOIN cand USING (c)
            LEFT JOIN w_{s - 1} b ON b.c = g.c AND b.token = g.token AND b.k = g.k),
        z_{s} AS MATERIALIZED (
            SELECT c, id, split, label, k, sum(x * w) AS z
            FROM design JOIN w_{s} USING (token) JOIN ds_split USING (id) GROUP BY c, id, split, label, k)""")
    curves = " UNION ALL ".join(f"SELECT {s} AS epoch, * FROM z_{s}" for s in range(1, steps + 1))
    parts.append(f"""
        scored AS (
            SELECT c, epoch, id, split, label,
                   max(z) + ln(sum(exp(z - top))) - max(CASE WHEN k = label THEN z END) AS loss, arg_max(k, z) = label AS hit
            FROM (SELECT *, max(z) OVER (PARTITION BY c, epoch, id) AS top FROM ({curves}))
            GROUP BY c, epoch, id, split, label),
        curve AS (
            SELECT c, epoch, split, count(*) AS n, avg(loss) AS loss, count_if(hit) / count(*) AS accuracy
            FROM scored GROUP BY c, epoch, split)""")
    return ", ".join(parts)


ORACLES: dict[str, str] = {
    "load_splits": """
        SELECT 'train' AS split, text FROM documents
        UNION ALL SELECT 'validation', text FROM conversations
        UNION ALL SELECT 'test', text FROM benchmark""",
    "resolve_splits": f"""
        WITH t AS (SELECT doc_id AS id, {_hash('test:42', 'doc_id')} AS h FROM documents)
        SELECT id, CASE WHEN row_number() OVER (ORDER BY h, id) <= ceil(0.1::DECIMAL(9, 6) * count(*) OVER ())
                        THEN 'test' ELSE 'train' END AS split
        FROM t
        UNION ALL SELECT conv_id * 1000 + turn, 'validation' FROM conversations""",
    "read_jsonl_roundtrip": f"WITH {_SPLIT} SELECT text, label, split FROM ds_split",
    "dataset_metadata": f"""
        WITH {_SPLIT},
        lengths AS (
            SELECT len({_words()}) AS n FROM
            (SELECT text FROM ds_split WHERE split = 'train')),
        stats AS (SELECT {_STATS} FROM lengths)
        SELECT 'documents' AS dataset_name, count(DISTINCT lang)::INTEGER AS num_classes,
               string_agg(DISTINCT lang, ',' ORDER BY lang) AS class_names, 'text' AS text_column,
               'lang' AS label_column, count(*) FILTER (split = 'train') AS n_train,
               count(*) FILTER (split = 'validation') AS n_val, count(*) FILTER (split = 'test') AS n_test,
               any_value(avg_words) AS avg_words, any_value(min_words) AS min_words,
               any_value(max_words) AS max_words,
               any_value(recommended_max_seq_length) AS recommended_max_seq_length
        FROM ds_split, stats""",
    "history_long": """
        SELECT vec_id::VARCHAR AS run_id, generate_subscripts(embedding, 1)::INTEGER AS epoch,
               unnest(embedding::DOUBLE[]) AS train_loss, unnest(list_reverse(embedding::DOUBLE[])) AS val_f1
        FROM embeddings""",
    "tracker_long": """
        SELECT vec_id::VARCHAR AS run_id, generate_subscripts(embedding, 1)::INTEGER AS epoch,
               unnest(embedding::DOUBLE[]) AS val_loss, unnest(list_reverse(embedding::DOUBLE[])) AS epoch_time
        FROM embeddings""",
    "history_roundtrip": f"WITH {_HIST} SELECT run_id::VARCHAR AS run_id, epoch, val_f1 FROM hist",
    "prepared_dataset": f"""
        WITH marked AS (
            SELECT doc_id AS id, text, quality::INTEGER AS label FROM documents JOIN labels USING (doc_id)),
        {_exact('marked_split', 'marked')}
        SELECT split, label, CASE label WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS class_name,
               count(*) AS n, sum(len({_words()}))::BIGINT AS words
        FROM marked_split GROUP BY split, label""",
    "results_flat": f"""
        WITH {_RUNS} SELECT run_id, dataset, training_time_minutes, f1_macro, epochs::VARCHAR AS num_epochs FROM runs""",
    "normalize": "SELECT doc_id AS id, text, quality AS label FROM documents JOIN labels USING (doc_id)",
    "class_catalog": """
        SELECT (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS label, lang AS class_name, 'lang' AS column
        FROM (SELECT DISTINCT lang FROM documents)
        UNION ALL
        SELECT (row_number() OVER (ORDER BY quality) - 1)::INTEGER AS label,
               'class_' || (row_number() OVER (ORDER BY quality) - 1) AS class_name, 'quality' AS column
        FROM (SELECT DISTINCT quality FROM labels)""",
    "decode_label": f"""
        WITH {_DS}, names AS (SELECT DISTINCT label, lang FROM ds)
        SELECT vec_id AS id, e.label, coalesce(lang, 'class_' || e.label) AS class_name
        FROM embeddings e LEFT JOIN names n ON n.label = e.label""",
    "sample_examples": f"""
        WITH {_SPLIT}
        SELECT id, label, lang AS class_name,
               CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview
        FROM ds_split WHERE split = 'train' ORDER BY id LIMIT 3""",
    "argmax_predict": f"WITH {_LOGITS} SELECT id, label, prediction::INTEGER AS prediction FROM losses",
    "cross_entropy": f"WITH {_LOGITS} SELECT id, round(nll, 6) AS loss FROM losses",
    "cross_entropy_smoothed": f"""
        WITH {_LOGITS} SELECT id, round((1 - 0.1::DOUBLE) * nll + 0.1::DOUBLE * mean_nll, 6) AS loss FROM losses""",
    "checkpoint_epochs": f"WITH {_HIST} SELECT run_id, epoch, val_f1 FROM hist WHERE epoch % 10 = 0",
    "word_count": f"SELECT doc_id AS id, len({_words()})::INTEGER AS words FROM documents",
    "build_vocab": f"WITH {_VOCAB} SELECT token, token_id, n FROM vocab",
    "encode_tokens": f"""
        WITH {_ENCODED} SELECT id, len(ids)::INTEGER AS length, array_to_string(ids, ' ') AS input_ids FROM enc""",
    "pad_truncate": f"WITH {_ENCODED} SELECT id, array_to_string(ids, ' ') AS input_ids FROM fixed",
    "attention_mask": f"""
        WITH {_ENCODED}
        SELECT id, array_to_string(list_transform(ids, lambda i: (i <> 0)::INTEGER), ' ') AS attention_mask
        FROM padded""",
    "last_valid_token": f"""
        WITH {_ENCODED} SELECT id, ids[CASE WHEN n_valid = 0 THEN 128 ELSE n_valid END] AS last_id FROM padded""",
    "make_batches": f"""
        WITH {_SPLIT},
        keyed AS (
            SELECT id, split, CASE WHEN split = 'train' THEN {_hash('shuffle:1')} ELSE 0 END AS k FROM ds_split)
        SELECT id, split, ((row_number() OVER (PARTITION BY split ORDER BY k, id) - 1) // 32)::BIGINT AS batch_id
        FROM keyed""",
    "split_test": f"WITH {_SPLIT} SELECT id, CASE WHEN in_test THEN 'test' ELSE 'train' END AS split FROM ds_split",
    "split_train_val_test": f"WITH {_SPLIT} SELECT id, split FROM ds_split",
    "split_by_text_hash": f"""
        SELECT doc_id AS id, CASE WHEN {_hash('test:42', 'text')} < floor(0.1::DECIMAL(9, 6) * 4294967296) THEN 'test'
            WHEN {_hash('val:42', 'text')} < floor(0.1::DECIMAL(9, 6) * 4294967296) THEN 'validation'
            ELSE 'train' END AS split
        FROM documents""",
    "split_three_way": f"""
        SELECT doc_id AS id, CASE WHEN h < floor(0.85::DECIMAL(9, 6) * 4294967296) THEN 'train'
            WHEN h < floor(0.95::DECIMAL(9, 6) * 4294967296) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT doc_id, {_hash('split:42', 'doc_id')} AS h FROM documents)""",
    "split_overlap": f"""
        WITH {_SPLIT}, seen AS (SELECT DISTINCT text FROM ds_split WHERE split = 'train')
        SELECT d.split, count(*) AS n, count(s.text) AS n_in_train, round(count(s.text) / count(*), 6) AS share_in_train
        FROM ds_split d LEFT JOIN seen s USING (text) WHERE d.split <> 'train' GROUP BY d.split""",
    "split_drift": f"""
        WITH {_SPLIT},
        shares AS (
            SELECT label,
                count(*) FILTER (split = 'train') / sum(count(*) FILTER (split = 'train')) OVER () AS train_share,
                count(*) FILTER (split = 'validation') / sum(count(*) FILTER (split = 'validation')) OVER () AS val_share,
                count(*) FILTER (split = 'test') / sum(count(*) FILTER (split = 'test')) OVER () AS test_share
            FROM ds_split GROUP BY label),
        long AS (
            SELECT 'validation' AS split, label, val_share AS share, train_share FROM shares
            UNION ALL SELECT 'test', label, test_share, train_share FROM shares)
        SELECT split, label, round(share, 6) AS share, round(train_share, 6) AS train_share,
               round(share - train_share, 6) AS drift
        FROM long""",
    "split_sizes": f"WITH {_SPLIT} SELECT split, count(*) AS n FROM ds_split GROUP BY split",
    "class_distribution": f"""
        WITH {_SPLIT}
        SELECT split, label, lang AS class_name, count(*) AS n,
               round(count(*) / sum(count(*)) OVER (PARTITION BY split) * 100, 6) AS pct
        FROM ds_split GROUP BY split, label, lang""",
    "text_stats": f"""
        WITH {_SPLIT}
        SELECT {_STATS} FROM (
            SELECT len({_words()}) AS n FROM
            (SELECT text FROM ds_split WHERE split = 'train'))""",
    "text_stats_full": f"""
        WITH {_SPLIT} SELECT {_STATS} FROM (SELECT len({_words()}) AS n FROM ds_split WHERE split = 'train')""",
    "confusion_matrix": f"WITH {_PRED} SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction",
    "per_class_metrics": f"""
        WITH {_PRED}, {_metrics('pred')}
        SELECT label, tp, predicted, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1
        FROM per_class""",
    "classification_metrics": f"WITH {_PRED}, {_metrics('pred')} SELECT * FROM summary",
    "unigram_loss": f"""
        WITH {_UNIGRAM}
        SELECT split, count(*) AS tokens, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 3) AS perplexity
        FROM scored GROUP BY split""",
    "unigram_perplexity": f"""
        WITH {_UNIGRAM},
        long AS (
            SELECT 'all' AS "grouping", 'all' AS value, nll FROM scored
            UNION ALL SELECT 'lang', lang, nll FROM scored
            UNION ALL SELECT 'source', source, nll FROM scored)
        SELECT "grouping", value, count(*) AS tokens, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 3) AS perplexity
        FROM long GROUP BY "grouping", value""",
    "token_accuracy": f"""
        WITH {_TOKENS},
        pairs AS (
            SELECT a.split, a.token AS previous, b.token, count(*) AS n
            FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1 GROUP BY ALL),
        best AS (
            SELECT previous, token FROM pairs WHERE split = 'train'
            QUALIFY row_number() OVER (PARTITION BY previous ORDER BY n DESC, token) = 1)
        SELECT sum(n)::BIGINT AS tokens,
               round(100 * sum(CASE WHEN b.token = p.token THEN n ELSE 0 END) / sum(n), 6) AS token_accuracy
        FROM pairs p LEFT JOIN best b ON b.previous = p.previous WHERE split <> 'train'""",
    "masked_token_metrics": f"""
        WITH {_ENCODED},
        size AS (SELECT sum(n) + count(*) + 1 AS d FROM vocab),
        positions AS (SELECT lang, unnest(ids) AS target FROM padded),
        scored AS (
            SELECT lang, target, -ln((coalesce(n, 0) + 1) / d::DOUBLE) AS nll
            FROM positions LEFT JOIN vocab ON token_id = target, size WHERE target <> 0)
        SELECT lang, round(100 * count(*) FILTER (target = 2) / count(*), 6) AS token_accuracy,
               round(avg(nll), 6) AS loss, round(exp(avg(nll)), 3) AS perplexity
        FROM scored GROUP BY lang""",
    "epoch_loss": f"""
        WITH {_LOGITS}, batches AS (SELECT batch_id, avg(nll) AS loss FROM losses GROUP BY batch_id)
        SELECT 'batch' AS weighting, round(avg(loss), 6) AS epoch_loss FROM batches
        UNION ALL SELECT 'example', round(avg(nll), 6) FROM losses""",
    "run_summary": """
        SELECT user_id AS run_id, round(sum(value), 6) AS total_time, round(avg(value), 6) AS avg_epoch_time,
               round(min(value / 100), 6) AS best_val_loss, round(min(exp(value / 100)), 6) AS best_val_perplexity
        FROM events GROUP BY user_id""",
    "best_epoch": f"""
        WITH {_HIST}
        SELECT run_id, epoch AS best_epoch, val_f1 AS best_val_f1 FROM hist WHERE val_f1 > 0
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY val_f1 DESC, epoch) = 1""",
    "improvement_streak": f"WITH {_STREAK} SELECT * FROM streaks",
    "early_stop": f"""
        WITH {_STREAK},
        stops AS (SELECT run_id, min(epoch) AS stop FROM streaks WHERE streak >= 10 GROUP BY run_id)
        SELECT run_id, epoch, val_f1, improved, streak, streak >= 10 AS stopped
        FROM streaks LEFT JOIN stops USING (run_id) WHERE epoch <= coalesce(stop, epoch)""",
    "running_accuracy": f"""
        WITH {_LOGITS},
        batches AS (
            SELECT 'vectors' AS run_id, batch_id, count(*) FILTER (label = prediction) AS correct, count(*) AS total
            FROM losses GROUP BY batch_id),
        sums AS (
            SELECT *, sum(correct) OVER (ORDER BY batch_id)::BIGINT AS running_correct,
                   sum(total) OVER (ORDER BY batch_id)::BIGINT AS running_total
            FROM batches)
        SELECT *, round(running_correct / running_total, 6) AS running_accuracy FROM sums""",
    "generalization_gap": f"""
        WITH {_PAIR},
        last AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) = 1),
        best AS (
            SELECT * FROM pair WHERE val_acc > 0
            QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY val_acc DESC, epoch) = 1)
        SELECT l.run_id, l.epoch AS last_epoch, round(l.train_acc - l.val_acc, 6) AS gap_last,
               b.epoch AS best_epoch, round(b.train_acc - b.val_acc, 6) AS gap_best
        FROM last l LEFT JOIN best b ON b.run_id = l.run_id""",
    "val_test_gap": f"""
        WITH {_PAIR},
        last AS (
            SELECT run_id, arg_max(val_acc, epoch) FILTER (val_acc IS NOT NULL) AS val_acc FROM pair GROUP BY run_id),
        test AS (
            SELECT user_id AS run_id, round(avg(value), 6) AS test_acc FROM events
            WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT run_id, val_acc, test_acc, round(val_acc - test_acc, 6) AS gap
        FROM last FULL JOIN test USING (run_id)""",
    "history_curves": f"""
        WITH {_PAIR}
        SELECT run_id, epoch, 'train_acc' AS metric, train_acc AS value FROM pair
        UNION ALL SELECT run_id, epoch, 'val_acc', val_acc FROM pair""",
    "history_perplexity": f"""
        WITH {_HIST}
        SELECT run_id, epoch, round(val_f1 / 100, 6) AS val_loss, round(exp(val_f1 / 100), 6) AS val_perplexity
        FROM hist""",
    "compare_runs": f"""
        WITH {_RUNS},
        long AS (
            SELECT run_id, 'f1_macro' AS metric, f1_macro AS value, 1 AS sign FROM runs
            UNION ALL SELECT run_id, 'training_time_minutes', training_time_minutes, -1 FROM runs
            UNION ALL SELECT run_id, 'epochs', epochs::DOUBLE, 0 FROM runs
            UNION ALL SELECT run_id, 'trainable_parameters', trainable_parameters::DOUBLE, 0 FROM runs)
        SELECT a.metric, a.value AS value_a, b.value AS value_b, round(a.value - b.value, 6) AS difference,
               CASE WHEN a.sign * (a.value - b.value) > 0 THEN 'view'
                    WHEN a.sign * (a.value - b.value) < 0 THEN 'click' END AS winner
        FROM long a JOIN long b ON a.metric = b.metric WHERE a.run_id = 'view' AND b.run_id = 'click'""",
    "run_efficiency": f"""
        WITH {_RUNS}
        SELECT run_id, training_time_minutes,
               round(training_time_minutes / min(training_time_minutes) OVER (), 6) AS ratio_to_fastest,
               round(training_time_minutes / 60 * 1.5::DOUBLE, 6) AS cost,
               round(trainable_parameters / total_parameters, 6) AS trainable_share, epochs,
               greatest(0, 2000 - epochs)::BIGINT AS epochs_saved
        FROM runs""",
    "leaderboard": """
        WITH scored AS (
            SELECT event_type AS dataset, user_id AS run_id, count(*) FILTER (value > 30) / count(*) AS f1_macro
            FROM events GROUP BY event_type, user_id)
        SELECT (rank() OVER (PARTITION BY dataset ORDER BY f1_macro DESC))::INTEGER AS rank, dataset, run_id, f1_macro
        FROM scored""",
    "keyword_classifier": f"""
        WITH {_TOKENS}, {_CLASSES}, {_KEYWORDS}
        SELECT id, split, label, prediction, round(raw, 3) AS score FROM keyword_best""",
    "train_from_text": f"""
        WITH {_TOKENS}, {_descent(_ONE)}
        SELECT epoch, split, n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM curve""",
    "save_and_reload": f"""
        WITH {_TOKENS}, {_descent(_ONE)}
        SELECT id, split, label, k AS prediction, round(z, 6) AS score FROM z_{_ONE[0][-1]}
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, k) = 1""",
    "train_head": f"""
        WITH RECURSIVE vectors AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
        {_exact('parts', 'vectors')},
        long AS MATERIALIZED (
            SELECT id, split, label, generate_subscripts(x, 1)::INTEGER AS dim, unnest(x) AS v FROM parts
            UNION ALL SELECT id, split, label, 1000000, 1.0 FROM parts),
        train AS (SELECT * FROM long WHERE split = 'train'),
        classes AS (SELECT DISTINCT label AS k FROM train),
        dims AS (SELECT dim, row_number() OVER (ORDER BY dim) AS i FROM (SELECT DISTINCT dim FROM train)),
        size AS (SELECT count(*) AS d FROM dims),
        gram AS (
            SELECT a.dim AS di, b.dim AS dj,
                   sum(a.v * b.v) + CASE WHEN a.dim = b.dim AND a.dim < 1000000 THEN 0.1 * count(*) ELSE 0 END AS v
            FROM train a JOIN train b USING (id) GROUP BY a.dim, b.dim),
        sums AS (
            SELECT dim AS di, k, sum(CASE WHEN label = k THEN v ELSE 0 END) AS v FROM train, classes GROUP BY dim, k),
        start AS (
            SELECT x.i, y.i AS j, v FROM gram JOIN dims x ON di = x.dim JOIN dims y ON dj = y.dim
            UNION ALL
            SELECT x.i, d + 1 + row_number() OVER (PARTITION BY di ORDER BY k), v
            FROM sums JOIN dims x ON di = x.dim, size),
        eliminated AS (
            SELECT 0 AS step, i, j, v FROM start
            UNION ALL
            SELECT g.step + 1, g.i, g.j,
                   CASE WHEN g.i = g.step + 1 THEN g.v / p.v ELSE g.v - c.v * r.v / p.v END
            FROM eliminated g
            JOIN eliminated p ON p.i = g.step + 1 AND p.j = g.step + 1
            JOIN eliminated c ON c.i = g.i AND c.j = g.step + 1
            JOIN eliminated r ON r.i = g.step + 1 AND r.j = g.j
            WHERE g.step < (SELECT d FROM size)),
        weights AS MATERIALIZED (
            SELECT dim, k, v AS w FROM eliminated JOIN dims USING (i)
            JOIN (SELECT k, row_number() OVER (ORDER BY k) AS nth FROM classes) c ON j = (SELECT d FROM size) + 1 + nth
            WHERE step = (SELECT d FROM size)),
        scores AS (
            SELECT id, split, label, k AS prediction, sum(l.v * w) AS score
            FROM long l JOIN weights USING (dim) GROUP BY id, split, label, k)
        SELECT id, split, label, prediction, round(score, 6) AS score FROM scores
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY scores.score DESC, prediction) = 1""",
    "predict_eval": f"""
        WITH vectors AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
        {_exact('parts', 'vectors')},
        long AS (
            SELECT id, split, label, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS value FROM parts),
        logits AS (
            SELECT id, split, label, c::INTEGER AS prediction, sum(value * ((7 * c + 3 * dim) % 11 - 5)) AS logit
            FROM long, range(4) AS classes(c) GROUP BY id, split, label, c)
        SELECT id, split, label, prediction, round(logit, 6) AS score FROM logits
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY logit DESC, prediction) = 1""",
    "select_model": f"""
        WITH ds AS (SELECT doc_id AS id, text, quality AS label FROM documents JOIN labels USING (doc_id)),
        {_exact('ds_split', 'ds')},
        tok AS (SELECT id, split, label, unnest({_words()}) AS token FROM ds_split),
        {_descent(_GRID)},
        chosen AS (
            SELECT c AS candidate, split, label, k AS prediction FROM z_{max(c[-1] for c in _GRID)}
            QUALIFY row_number() OVER (PARTITION BY c, id ORDER BY z DESC, k) = 1),
        {_metrics('chosen', 'candidate, split')},
        tried AS (
            SELECT c AS candidate, l2, rate, steps, coalesce(f1_macro, 0) AS val_f1_macro
            FROM cand LEFT JOIN summary ON candidate = c AND split = 'validation'),
        ranked AS (
            SELECT *, val_f1_macro > 0 AND row_number() OVER (ORDER BY val_f1_macro DESC, candidate) = 1 AS best FROM tried)
        SELECT r.candidate, l2, rate, steps, round(val_f1_macro, 6) AS val_f1_macro, best,
               round(accuracy, 6) AS test_accuracy, round(f1_macro, 6) AS test_f1_macro,
               round(f1_weighted, 6) AS test_f1_weighted
        FROM ranked r LEFT JOIN summary s ON s.candidate = r.candidate AND split = 'test' AND best""",
    "centroid_classifier": f"""
        WITH vectors AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
        {_exact('parts', 'vectors')},
        long AS (
            SELECT id, split, label, generate_subscripts(x, 1) AS dim, unnest(x) AS value FROM parts),
        means AS (SELECT label, dim, avg(value) AS mean FROM long WHERE split = 'train' GROUP BY label, dim),
        bias AS (SELECT label, -0.5 * sum(mean * mean) AS bias FROM means GROUP BY label),
        scores AS (
            SELECT l.id, l.split, l.label, m.label AS prediction, round(sum(value * mean) + any_value(bias), 6) AS score
            FROM long l JOIN means m USING (dim) JOIN bias b ON b.label = m.label
            GROUP BY l.id, l.split, l.label, m.label)
        SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, prediction) = 1""",
    "experiment": f"""
        WITH {_TOKENS}, {_CLASSES}, {_KEYWORDS}, {_CENTROIDS},
        recipes AS (
            SELECT 'keywords' AS run_id, split, label, prediction FROM keyword_best WHERE split <> 'train'
            UNION ALL SELECT 'centroids', split, label, prediction FROM centroid_best WHERE split <> 'train'),
        {_metrics('recipes', 'run_id, split')},
        test AS (SELECT *, 'documents' AS dataset FROM summary WHERE split = 'test'),
        val AS (SELECT run_id, f1_macro AS best_val_f1 FROM summary WHERE split = 'validation')
        SELECT t.* EXCLUDE (split), best_val_f1, (rank() OVER (ORDER BY f1_macro DESC))::INTEGER AS rank
        FROM test t LEFT JOIN val USING (run_id)""",
}
