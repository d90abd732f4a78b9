"""SQL for DuckDB that computes the registered queries in its own way.

Named parts are joined into one WITH query per key; every part reads whole tables.
"""

from __future__ import annotations

from checks.recursive import recursive_sql

# Fixed values shared with the engine under test.
TOKEN = r"[ \t\n\r]*(?:[\p{L}\p{N}_]+|[^ \t\n\r\p{L}\p{N}_])"
DOC_TOKENS = (
    "list_filter(string_split_regex(lower(regexp_replace({0}, '[^a-zA-Z0-9]', ' ', 'g')), ' +'),"
    " lambda w: w <> '')"
)
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
QUERY_TOKENS = r"list_filter(string_split_regex(lower({0}), '[\s\p{{Z}}]+'), lambda w: w <> '')"
N_TOKENS = "len(regexp_extract_all({0}, '" + TOKEN.replace("{", "{{").replace("}", "}}") + "'))"


def _words(source: str, key: str, tokens: str) -> str:
    return f"SELECT {key}, unnest({tokens}) AS term FROM {source}"


def _embedding(prefix: str, source: str, key: str, text: str) -> dict[str, tuple[str, str]]:
    """Sparse unit vectors <prefix>_vec(key, bucket, v) and their lengths <prefix>_len(key, l)."""
    return {
        f"{prefix}_sum": (
            source,
            f"""SELECT {key}, ('0x' || substring(md5(term), 1, 7))::BIGINT % 768 AS bucket,
                sum(CASE WHEN substring(md5(term), 8, 1) >= '8' THEN -1 ELSE 1 END)::DOUBLE AS s
            FROM ({_words(source, key, WORDS.format(text))}) GROUP BY ALL""",
        ),
        f"{prefix}_vec": (
            f"{prefix}_sum",
            f"""SELECT {key}, bucket, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v
            FROM {prefix}_sum QUALIFY s <> 0""",
        ),
        f"{prefix}_len": (
            f"{prefix}_vec",
            f"SELECT {key}, sqrt(sum(v * v)) AS l FROM {prefix}_vec GROUP BY ALL",
        ),
    }


def _bm25(prefix: str, items: str) -> dict[str, tuple[str, str]]:
    """Scores of items(id, text) against the benchmark questions."""
    return {
        f"{prefix}_doc": (items, f"SELECT id, {DOC_TOKENS.format('text')} AS tokens FROM {items}"),
        f"{prefix}_size": (
            f"{prefix}_doc",
            f"SELECT count(*) AS n, avg(len(tokens))::DOUBLE AS avgdl FROM {prefix}_doc",
        ),
        f"{prefix}_post": (
            f"{prefix}_doc",
            f"""SELECT id, term, dl, count(*) AS tf
            FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM {prefix}_doc) GROUP BY ALL""",
        ),
        f"{prefix}_raw": (
            f"{prefix}_post {prefix}_size",
            f"""SELECT term, count(*) AS df,
                ln((SELECT n FROM {prefix}_size) - count(*)::DOUBLE + 0.5::DOUBLE)
                  - ln(count(*)::DOUBLE + 0.5::DOUBLE) AS raw
            FROM {prefix}_post GROUP BY term""",
        ),
        f"{prefix}_term": (
            f"{prefix}_raw",
            f"""SELECT term, df,
                round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {prefix}_raw) ELSE raw END, 9) AS idf
            FROM {prefix}_raw""",
        ),
        f"{prefix}_match": (
            f"{prefix}_term {prefix}_post {prefix}_size question_term",
            f"""SELECT query_id, id, floor((sum(round(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE
                * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM {prefix}_size)))
                * 1000000000::DOUBLE)::BIGINT)::DOUBLE + 500) / 1000::DOUBLE) / 1000000::DOUBLE AS score
            FROM question_term JOIN {prefix}_term USING (term) JOIN {prefix}_post USING (term)
            GROUP BY query_id, id""",
        ),
        f"{prefix}_rank": (
            f"{prefix}_match question {items}",
            f"""SELECT query_id, id, coalesce(score, 0) AS score,
                row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id)::INTEGER AS rank
            FROM question CROSS JOIN (SELECT id FROM {items}) LEFT JOIN {prefix}_match USING (query_id, id)""",
        ),
    }


def _splice(k: int, n_semantic: int, semantic: str = "semantic", ranks: str = "chunk_rank") -> str:
    place = min(k, n_semantic)
    return f"""SELECT query_id, id, (CASE WHEN rank <= {place} THEN rank - 1 ELSE rank - 1 + {k} END)::INTEGER AS pos
        FROM {semantic} WHERE rank <= {n_semantic}
        UNION ALL SELECT query_id, id, ({place} + rank - 1)::INTEGER FROM {ranks} WHERE rank <= {k}"""


def _near(vectors: str, lengths: str) -> str:
    return f"""SELECT query_id, id, round(d / (q.l * c.l), 6) AS score
        FROM (SELECT q.query_id, c.id, sum(q.v * c.v) AS d
              FROM question_vec q JOIN {vectors} c USING (bucket) GROUP BY ALL)
        JOIN question_len q USING (query_id) JOIN {lengths} c USING (id)"""


def _semantic(near: str, chunks: str) -> str:
    return f"""SELECT query_id, id, coalesce(score, 0) AS score,
            row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id)::INTEGER AS rank
        FROM question CROSS JOIN (SELECT id FROM {chunks}) LEFT JOIN {near} USING (query_id, id)"""


PARTS: dict[str, tuple[str, str]] = {
    "question": ("", "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "question_term": (
        "question",
        f"""SELECT query_id, term, count(*) AS qtf
        FROM ({_words('question', 'query_id', QUERY_TOKENS.format('query'))}) GROUP BY ALL""",
    ),
    "item": ("", "SELECT doc_id AS id, text FROM documents"),
    "chunk": (
        "",
        """SELECT sha256(source || '|' || doc_id || '|' || off // 950 || '|' || substring(text, off + 1, 1000)) AS id,
            doc_id, source, (off // 950)::INTEGER AS chunk_no, substring(text, off + 1, 1000) AS text
        FROM (SELECT doc_id, source, text, unnest(range(0, length(text), 950)) AS off FROM documents)""",
    ),
    "judged": (
        "chunk",
        """SELECT *, max(CASE WHEN md5(text)[1:2] = '00' THEN 'ValueError: refused' END)
              OVER (PARTITION BY source, place // 64) AS error
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_no) - 1 AS place FROM chunk)""",
    ),
    "web_chunk": (
        "",
        """SELECT page_id AS doc_id, url AS source, (off // 950)::INTEGER AS chunk_no,
            substring(html, off + 1, 1000) AS text
        FROM (SELECT page_id, url, html, unnest(range(0, length(html), 950)) AS off
              FROM pages WHERE suffix(url, '.html'))""",
    ),
    **_embedding("chunk", "chunk", "id", "text"),
    **_embedding("question", "question", "query_id", "query"),
    **_embedding("item", "item", "id", "text"),
    **_bm25("item", "item"),
    **_bm25("chunk", "chunk"),
    "near": ("chunk_vec chunk_len question_vec question_len", _near("chunk_vec", "chunk_len")),
    "semantic": ("near question chunk", _semantic("near", "chunk")),
    "short": (
        "",
        """SELECT sha256(source || '|' || doc_id || '|' || off // 650 || '|' || substring(text, off + 1, 700)) AS id,
            source, substring(text, off + 1, 700) AS text
        FROM (SELECT doc_id, source, text, unnest(range(0, length(text), 650)) AS off FROM documents)""",
    ),
    **_embedding("short", "short", "id", "text"),
    **_bm25("short", "short"),
    "short_near": ("short_vec short_len question_vec question_len", _near("short_vec", "short_len")),
    "short_semantic": ("short_near question short", _semantic("short_near", "short")),
    "short_spliced": ("short_semantic short_rank", _splice(5, 30, "short_semantic", "short_rank")),
    "spliced3": ("semantic chunk_rank", _splice(3, 5)),
    "spliced1": ("semantic chunk_rank", _splice(1, 5)),
    "hit": ("spliced1 chunk", "SELECT query_id, pos, id, text, source FROM spliced1 JOIN chunk USING (id)"),
    "reranked": (
        "hit",
        f"""SELECT query_id, pos, id, text, source, row_number() OVER (PARTITION BY query_id
              ORDER BY {N_TOKENS.format('text')} DESC, source, pos)::INTEGER AS rank
        FROM hit""",
    ),
    "gathered": (
        "hit",
        r"""SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS context,
            string_agg(id, ',' ORDER BY pos) AS document_ids,
            array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
        FROM hit GROUP BY query_id""",
    ),
    "prompt": (
        "gathered question",
        """SELECT query_id, query, document_ids, sources,
            'Context:' || chr(10) || context || chr(10) || chr(10) || 'User Query:' || chr(10) || query AS prompt
        FROM question JOIN gathered USING (query_id)""",
    ),
    "budgeted": (
        "hit",
        f"""SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM (SELECT *, {N_TOKENS.format('text')} AS tokens FROM hit)""",
    ),
    "middle": (
        "",
        """SELECT list(x ORDER BY d) AS q
        FROM (SELECT d, avg(x) AS x
              FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS d FROM embeddings) GROUP BY ALL)""",
    ),
    "share": (
        "",
        """SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS p FROM embeddings""",
    ),
    "power": (
        "",
        """SELECT vec_id, list_transform(e, lambda x: exp(x - top)) AS w
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(embedding)::DOUBLE AS top FROM embeddings)""",
    ),
    "soft": (
        "power",
        "SELECT vec_id, list_transform(w, lambda x: x / total) AS p"
        " FROM (SELECT vec_id, w, list_sum(w) AS total FROM power)",
    ),
}

# Parts that several others read.
KEPT = {"chunk", "chunk_vec", "question_vec", "near", "chunk_post", "item_post", "chunk_match", "hit", "semantic"}


def _query(needs: str, select: str) -> str:
    """WITH the needed parts, each after the parts it needs itself."""
    order: list[str] = []

    def visit(part: str) -> None:
        if part in order:
            return
        for below in PARTS[part][0].split():
            visit(below)
        order.append(part)

    for part in needs.split():
        visit(part)
    if not order:
        return select
    body = ",\n".join(
        f"{p} AS {'MATERIALIZED ' if p in KEPT else ''}({PARTS[p][1]})" for p in order
    )
    return f"WITH {body}\n{select}"


def _nearest(score: str, direction: str) -> str:
    return f"""SELECT query_id, rank, id, score FROM (
        SELECT query_id, id, score,
            row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id)::INTEGER AS rank
        FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({score}, 6) AS score
              FROM (SELECT vec_id, embedding::DOUBLE[] AS q FROM embeddings) a
              CROSS JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b))
        WHERE rank <= 5"""


# R1 to R3 without look-around, which RE2 lacks: punctuation before white space is marked first.
_MARKED = r"regexp_replace(text, '([?.,!])([\s\p{Z}])', chr(1) || '\1\2', 'g')"
_SPACED = rf"replace(regexp_replace({_MARKED}, '([\p{{L}}\p{{N}}_])([?.,!])', '\1 \2', 'g'), chr(1), '')"
_DROPPED = f"translate(replace(translate({_SPACED}, '_-#', '   '), '.html', ''), '.', ' ')"


def _camel(text: str) -> str:
    split = rf"regexp_replace({text}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return rf"trim(regexp_replace({split}, '[\s\p{{Z}}]+', ' ', 'g'))"


_BASIC = rf"array_to_string(regexp_extract_all(lower({_camel(_DROPPED)}), '[\p{{L}}\p{{N}}_]+|[^\s\p{{Z}}\p{{L}}\p{{N}}_]'), ' ')"
_STRIPPED = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


def _label(p: str, threshold: float) -> str:
    return (
        f"CASE WHEN list_max({p}) >= {threshold}::DOUBLE"
        f" THEN 'class ' || (list_position({p}, list_max({p})) - 1) ELSE 'other' END"
    )


def _counts(source: str, key: str) -> str:
    return f"""SELECT {key}, term, count(*) AS tf
        FROM (SELECT {key}, unnest(string_split({_BASIC}, ' ')) AS term FROM {source}) GROUP BY ALL"""


def _tagged(counts: str, key: str) -> str:
    """Naive Bayes from the documents with labels: a word counts one more than it occurs."""
    return f"""SELECT {key}, CASE WHEN greatest(p, 1 - p) < 0.9::DOUBLE THEN 'other'
              WHEN 1 - p >= p THEN 'low' ELSE 'high' END AS tag
        FROM (SELECT {key}, 1 / (1 + exp((SELECT max(prior) FILTER (quality = 0) - max(prior) FILTER (quality = 1) FROM nb_prior)
                + coalesce(sum(tf * (w0 - w1)), 0))) AS p
              FROM {counts} LEFT JOIN nb_word USING (term) GROUP BY {key})"""


PARTS |= {
    "nb_count": (
        "",
        f"""SELECT quality, term, count(*) AS tf
        FROM (SELECT quality, unnest(string_split({_BASIC}, ' ')) AS term
              FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""",
    ),
    "nb_prior": (
        "",
        """SELECT quality, ln(count(*)::DOUBLE + 1) AS prior FROM documents JOIN labels USING (doc_id) GROUP BY quality""",
    ),
    "nb_word": (
        "nb_count",
        """SELECT term,
            ln(coalesce(sum(tf) FILTER (quality = 0), 0)::DOUBLE + 1)
              - ln((SELECT sum(tf) FROM nb_count WHERE quality = 0)::DOUBLE + (SELECT count(DISTINCT term) FROM nb_count)) AS w0,
            ln(coalesce(sum(tf) FILTER (quality = 1), 0)::DOUBLE + 1)
              - ln((SELECT sum(tf) FROM nb_count WHERE quality = 1)::DOUBLE + (SELECT count(DISTINCT term) FROM nb_count)) AS w1
        FROM nb_count GROUP BY term""",
    ),
    "item_words": ("", _counts("documents", "doc_id")),
    "item_tag": ("item_words nb_prior nb_word", _tagged("item_words", "doc_id")),
    "short_hit": (
        "short_spliced short",
        "SELECT query_id, pos, id, text, source FROM short_spliced JOIN short USING (id)",
    ),
    "short_words": ("short_hit", _counts("(SELECT DISTINCT id, text FROM short_hit)", "id")),
    "short_tag": ("short_words nb_prior nb_word", _tagged("short_words", "id")),
    "served": (
        "short_hit short_tag",
        """SELECT * FROM (SELECT query_id, id, text, source,
              row_number() OVER (PARTITION BY query_id ORDER BY tag, pos) AS rank
            FROM short_hit JOIN short_tag USING (id)) WHERE rank <= 10""",
    ),
    "served_prompt": (
        "served question",
        """SELECT query_id, query, string_agg(id, ',' ORDER BY rank) AS document_ids,
            array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
            'Context:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10)
              || 'User Query:' || chr(10) || query AS prompt
        FROM question JOIN served USING (query_id) GROUP BY query_id, query""",
    ),
}
KEPT |= {"short", "short_vec", "short_post", "short_match", "short_hit", "short_semantic", "nb_count", "nb_word"}

_TOKENS_OUT = "len({0})::INTEGER AS n_tokens, md5(array_to_string({0}, ' ')) AS tokens_md5"


def _trim(limit: str) -> str:
    return f"array_to_string(list_slice(regexp_extract_all(text, '{TOKEN}'), 1, {limit}), '')"



ORACLE_SQL: dict[str, str] = {
    "scan_filter_suffix": "SELECT page_id, url, suffix(url, '.html') AS accepted FROM pages",
    "page_concat": """SELECT conv_id AS doc_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5
        FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""",
    "page_chunks": """SELECT doc_id, (off // 950)::INTEGER AS chunk_no, length(c)::INTEGER AS n_chars, md5(c) AS text_md5
        FROM (SELECT doc_id, off, substring(t, off + 1, 1000) AS c
              FROM (SELECT conv_id AS doc_id, t, unnest(range(0, length(t), 950)) AS off
                    FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t
                          FROM conversations GROUP BY conv_id)))""",
    "scroll_page": _query(
        "chunk",
        """SELECT id, md5(text) AS text_md5, source, next_cursor
        FROM (SELECT *, row_number() OVER (ORDER BY id) AS r,
                nth_value(id, 101) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                  AS next_cursor
              FROM chunk WHERE id >= '8')
        WHERE r <= 100""",
    ),
    "scroll_compacted": _query(
        "chunk",
        """SELECT id, md5(text) AS text_md5, source, next_cursor
        FROM (SELECT *, row_number() OVER (ORDER BY id) AS r,
                nth_value(id, 101) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
                  AS next_cursor
              FROM chunk WHERE id >= '8')
        WHERE r <= 100""",
    ),
    "all_documents": _query("chunk", "SELECT id, md5(text) AS text_md5, source FROM chunk"),
    "upsert_latest": """SELECT doc_id AS id,
            md5(CASE WHEN quality IS NULL THEN text ELSE text || ' ' || quality END) AS text_md5,
            source, (quality IS NOT NULL)::INTEGER AS ingest_batch
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "chunk_fixed": _query(
        "chunk",
        "SELECT doc_id, source, chunk_no, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM chunk",
    ),
    "chunk_ids": _query("chunk", "SELECT id AS chunk_id, doc_id, chunk_no FROM chunk"),
    "chunk_recursive": recursive_sql(500, 50),
    "build_index_summary": f"""SELECT coalesce(source, 'Unknown') AS source, count(*) AS n_points, count(*) AS n_fitting,
            max(c.n_chars) AS longest
        FROM ({recursive_sql(500, 50)}) AS c JOIN documents USING (doc_id) GROUP BY ALL""",
    "chunk_recursive_invariants": r"""SELECT doc_id, true AS within_size, true AS found_in_text,
            md5(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS squeezed_md5
        FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')""",
    "embed_hash": _query(
        "item_vec", "SELECT id AS doc_id, bucket::INTEGER AS bucket, round(v, 6) AS value FROM item_vec"
    ),
    "embed_model": """SELECT doc_id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS v1,
            (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS v2,
            ('0x' || md5(text)[1:2])::INTEGER::DOUBLE AS v3, NULL::VARCHAR AS error
        FROM documents""",
    "embed_logged": """SELECT doc_id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS v1,
            (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS v2,
            ('0x' || md5(text)[1:2])::INTEGER::DOUBLE AS v3, NULL::VARCHAR AS error
        FROM documents""",
    "embed_batch_failure": _query(
        "judged", "SELECT id AS chunk_id, source, error IS NULL AS valid, error FROM judged"
    ),
    "valid_embeddings": _query(
        "judged",
        "SELECT id AS chunk_id, 4 AS dim, length(text)::DOUBLE AS v0 FROM judged WHERE error IS NULL",
    ),
    "vector_topk": _query(
        "middle",
        """SELECT row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS id,
            'label ' || label AS text, 'Unknown' AS source, score
        FROM (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score
              FROM embeddings CROSS JOIN middle)
        ORDER BY score DESC, vec_id LIMIT 10""",
    ),
    "knn_join": _query("", _nearest("list_cosine_similarity(e, q)", "DESC")),
    "knn_dot": _query("", _nearest("list_dot_product(e, q)", "DESC")),
    "knn_euclid": _query("", _nearest("list_distance(e, q)", "ASC")),
    "knn_quantized": _query("", _nearest("list_cosine_similarity(e, q)", "DESC")),
    "quantized_share": """SELECT count(*) * least(count(*), 5) AS n_hits, count(*) * least(count(*), 5) AS n_found,
            true AS few_pairs
        FROM embeddings""",
    "dim_check": "SELECT vec_id AS id, len(embedding[1:64 - label]) = 64 AS accepted FROM embeddings",
    "semantic_search": _query(
        "semantic chunk",
        """SELECT query_id, rank, id, md5(text) AS text_md5, source
        FROM semantic JOIN chunk USING (id) WHERE rank <= 5""",
    ),
    "doc_tokens": f"SELECT doc_id, {_TOKENS_OUT.format(DOC_TOKENS.format('text'))} FROM documents",
    "query_tokens": f"SELECT item_id AS query_id, {_TOKENS_OUT.format(QUERY_TOKENS.format('text'))} FROM benchmark",
    "bm25_stats": _query("item_term", "SELECT term, df, round(idf, 6) AS idf FROM item_term"),
    "bm25_corpus": _query("item_size", "SELECT n, round(avgdl, 6) AS avgdl FROM item_size"),
    "bm25_scores": _query("item_match", "SELECT query_id, id, score FROM item_match"),
    "bm25_topk": _query("item_rank", "SELECT query_id, rank, id, score FROM item_rank WHERE rank <= 5"),
    "bm25_index_topk": _query("item_rank", "SELECT query_id, rank, id, score FROM item_rank WHERE rank <= 5"),
    "bm25_index_terms": _query("item_term", "SELECT term, df, round(idf, 6) AS idf FROM item_term"),
    "bm25_index_scores": _query(
        "item_match item_rank",
        """SELECT query_id, id, m.score FROM item_match AS m JOIN item_rank AS r USING (query_id, id) WHERE rank <= 5""",
    ),
    "hybrid_splice": _query("spliced3", "SELECT query_id, pos, id FROM spliced3"),
    "hybrid_search": _query("hit", "SELECT query_id, pos, id, md5(text) AS text_md5, source FROM hit"),
    "camel_split": f"SELECT doc_id, md5({_camel('text')}) AS text_md5 FROM documents",
    "preprocess_text": f"SELECT doc_id, md5({_BASIC}) AS text_md5 FROM documents",
    "classify_threshold": _query(
        "share", f"SELECT vec_id, {_label('p', 0.1)} AS tag, round(list_max(p), 6) AS p FROM share"
    ),
    "softmax_classify": _query(
        "soft",
        f"SELECT vec_id, {_label('p', 0.022)} AS tag, round(list_max(p), 6) AS p, round(p[1], 6) AS p_first FROM soft",
    ),
    "rerank_sort": _query("reranked", "SELECT query_id, rank, pos, id, source FROM reranked"),
    "rerank_topk": _query("reranked", "SELECT query_id, rank, pos, id, source FROM reranked WHERE rank <= 3"),
    "rerank_indices": _query(
        "reranked",
        """SELECT query_id, rank, min(pos) OVER (PARTITION BY query_id, id, text, source) AS index FROM reranked""",
    ),
    "context_concat": _query(
        "gathered", "SELECT query_id, length(context)::INTEGER AS n_chars, md5(context) AS context_md5 FROM gathered"
    ),
    "context_ids": _query("gathered", "SELECT query_id, document_ids FROM gathered"),
    "context_sources": _query("gathered", "SELECT query_id, sources FROM gathered"),
    "build_prompts": _query(
        "prompt", "SELECT query_id, length(prompt)::INTEGER AS n_chars, md5(prompt) AS prompt_md5 FROM prompt"
    ),
    "answer_strip": _query(
        "chunk",
        f"SELECT id AS chunk_id, length({_STRIPPED})::INTEGER AS n_chars, md5({_STRIPPED}) AS text_md5 FROM chunk",
    ),
    "answer_records": _query(
        "prompt",
        f"""SELECT query_id, md5(query) AS question_md5, sources, document_ids,
            md5({_STRIPPED.replace('text', 'prompt', 1)}) AS answer_md5 FROM prompt""",
    ),
    "answer_service": _query(
        "served_prompt",
        f"""SELECT query_id, md5(query) AS question_md5, sources, document_ids,
            md5({_STRIPPED.replace('text', 'prompt', 1)}) AS answer_md5 FROM served_prompt""",
    ),
    "classify_docs": _query("item_tag", "SELECT doc_id, tag AS predicted_tag FROM item_tag"),
    "token_count": f"SELECT doc_id, {N_TOKENS.format('text')}::INTEGER AS n_tokens FROM documents",
    "token_trim": f"SELECT doc_id, md5({_trim('100')}) AS text_md5 FROM documents",
    "context_budget": _query(
        "budgeted",
        f"""SELECT query_id, pos, id, least(tokens, 512 - before)::BIGINT AS tokens,
            md5(CASE WHEN tokens <= 512 - before THEN text ELSE {_trim('512 - before')} END) AS text_md5
        FROM budgeted WHERE before < 512""",
    ),
    "ingest_fixed": _query(
        "chunk chunk_vec",
        """SELECT id, any_value(source) AS source, md5(any_value(text)) AS text_md5, 768 AS dim,
            count(bucket)::INTEGER AS n_nonzero
        FROM chunk LEFT JOIN chunk_vec USING (id) GROUP BY id""",
    ),
    "ingest_report": _query(
        "chunk web_chunk",
        """SELECT path, min(name) AS source, max(n_chunks) AS n_chunks, max(n_valid) AS n_valid, max(status) AS status FROM (
          SELECT path, name, CASE WHEN accepted AND NOT failed THEN coalesce(n_chunks, 0) ELSE 0 END AS n_chunks,
            CASE WHEN accepted AND NOT failed THEN coalesce(n_chunks, 0) ELSE 0 END AS n_valid,
            CASE WHEN NOT accepted THEN 'skipped' WHEN failed THEN 'error' WHEN coalesce(n_chunks, 0) = 0 THEN 'no text'
              ELSE 'stored' END AS status
          FROM (SELECT DISTINCT source AS path, source AS name, true AS accepted, false AS failed FROM documents
                UNION ALL
                SELECT url, CASE WHEN suffix(url, '.html') THEN string_split(url, '/')[-1] ELSE url END,
                  suffix(url, '.html'), md5(html)[1:1] = '0' FROM pages)
          LEFT JOIN (SELECT source AS path, count(*) AS n_chunks
                FROM (SELECT source FROM chunk UNION ALL SELECT source FROM web_chunk) GROUP BY source) USING (path)
        ) GROUP BY path""",
    ),
}
