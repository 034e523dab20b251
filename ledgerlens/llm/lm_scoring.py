"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

A document's tokens are its words, A-Z in lower case, and one end. The model is

    p(token | the ``context`` classes before it) = p(class | context) * p(token | class).

The most frequent training words are classes of their own, the end is one, and all other
words, known or not, fall in ``suffixes`` classes by a hash of their last two characters.
p(class | context) is log-bilinear: the context's embeddings, each through the matrix of
its position, add up to a prediction, whose inner products with the class vectors (plus a
bias each) go through a softmax, computed for all tokens of a batch by matrix products
and summed over every class, so the probabilities are normalised. p(token | class) are
the training counts of the class's words, each plus 1/2, with one more slot of 1/2 for
all words without a count. It is 1 for classes of one word. The base score is the
unigram form of the same counts.

Training needs no normaliser: noise-contrastive estimation tells each true class from
``noise`` classes drawn from the class frequencies. A round gives every task the model,
each trains it on its training documents of that round by Adagrad, and the models are
averaged by their numbers of tokens, in a tree of tasks. Every training document is used
in one round. Biases start at the log class frequencies and class vectors at 0, so the
untrained model is the class unigram one.

How it runs. A scan numbers the words of each run of documents (a part ends with the
document that brings it to ``PART_BYTES`` of text) and writes number sequences and
the part's vocabulary with counts; words leave a part once, so the commonest word is
one row a part. The counts are added up by word and joined back to the vocabularies;
sorted by part, vocabulary before documents, a task turns numbers into classes holding
one vocabulary at a time. Training and scoring read the class sequences only. What
reaches the driver or every task are the ``words`` frequent words, two numbers a class
and the weights: bounded by the rule, not by the data.

Defined results: a null or empty text is one end; ids may be null or repeat, each row is
a document; a null held-out mark counts as not held out; very long texts are taken
whole; without training documents every token has the base score 0 and the model gives
the classes equal shares; an empty table gives no rows; other columns are ignored. The
weights, hence the last digits of a score, depend on how the rows are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.graph import cut
from ledgerlens.session import scratch_path

PART_BYTES = 24 << 20
#: Words of a vocabulary in one row, tokens scored by one product, models added by one task.
ROW_WORDS, SCORED, FAN_IN = 20000, 1024, 32
#: A model is averaged over one task for each so many training tokens of a round, if there are as many partitions.
TRAINER_TOKENS = 500_000
#: Stands behind every word's number, so that a part's documents follow its vocabulary.
DOCUMENT = (1 << 31) - 1
SEED = 1913


@dataclass(frozen=True)
class Rule:
    """Sizes of the model and of its training."""

    words: int = 64
    suffixes: int = 192
    context: int = 4
    dims: int = 16
    noise: int = 16
    batch: int = 512
    rounds: int = 3
    rate: float = 0.2

    @property
    def end(self) -> int:
        return self.words + self.suffixes

    @property
    def classes(self) -> int:
        return self.words + self.suffixes + 1

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Context embeddings (the last one stands before the text), position matrices, class vectors, biases."""
        return {"embed": (self.classes + 1, self.dims), "turn": (self.context * self.dims, self.dims),
                "vector": (self.classes, self.dims), "bias": (self.classes,)}


# --- the model, in numpy -----------------------------------------------------

def start(rule: Rule, counts: np.ndarray) -> np.ndarray:
    """The first state: weights, then Adagrad's sums of squares, as one array."""
    rng = np.random.default_rng(SEED)
    weights = {"embed": rng.standard_normal(rule.shapes["embed"]) * 0.1,
               "turn": np.concatenate([np.eye(rule.dims) * 0.5 ** j for j in range(rule.context)]),
               "vector": np.zeros(rule.shapes["vector"]), "bias": np.log(noise_shares(counts))}
    flat = np.concatenate([w.ravel() for w in weights.values()])
    return np.concatenate([flat, np.full(len(flat), 0.1)])


def noise_shares(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts.sum() + 0.5 * len(counts))


def parts_of(state: np.ndarray, rule: Rule) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(weights, sums of squares) as float32 arrays by name."""
    out, at = [], 0
    for _ in range(2):
        named = {}
        for name, shape in rule.shapes.items():
            size = int(np.prod(shape))
            named[name] = state[at:at + size].reshape(shape).astype(np.float32)
            at += size
        out.append(named)
    return out[0], out[1]


def _guesses(weights: dict[str, np.ndarray], contexts: np.ndarray) -> np.ndarray:
    """The prediction of each context, and a 1 that meets the bias."""
    out = np.ones((len(contexts), weights["turn"].shape[1] + 1), np.float32)
    np.matmul(weights["embed"][contexts].reshape(len(contexts), -1), weights["turn"], out=out[:, :-1])
    return out


def _class_table(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights["vector"].T, weights["bias"][None, :]])


def log_probabilities(weights: dict[str, np.ndarray], contexts: np.ndarray) -> np.ndarray:
    """ln p(class | context) for every class: one row a context, each summing to 1 as probabilities."""
    z = _guesses(weights, contexts) @ _class_table(weights)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(sequences: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(padded classes, places of the tokens in them): each text starts after ``context`` paddings."""
    pad = np.full(rule.context, rule.classes, np.uint16)
    padded = np.concatenate([x for s in sequences for x in (pad, s)])
    return padded, np.flatnonzero(padded != rule.classes)


def contexts_of(padded: np.ndarray, places: np.ndarray, rule: Rule) -> np.ndarray:
    """The classes before each place, nearest first."""
    return padded[places[:, None] - np.arange(1, rule.context + 1)]


def _scattered(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of the values' rows that go to the same of ``count`` rows."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    out = np.zeros((count, values.shape[1]), np.float32)
    out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def nce_step(weights: dict, squares: dict, contexts: np.ndarray, truth: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray, rule: Rule) -> None:
    """One Adagrad step on a batch: the true classes against the drawn ones, in place."""
    n = len(truth)
    seen = weights["embed"][contexts].reshape(n, -1)
    guess = seen @ weights["turn"]
    of_truth, of_drawn = weights["vector"][truth], weights["vector"][drawn]
    margin = weights["bias"] - log_noise
    up = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", guess, of_truth) + margin[truth]))) - 1
    down = 1 / (1 + np.exp(-(guess @ of_drawn.T + margin[drawn])))
    error = up[:, None] * of_truth + down @ of_drawn
    both = np.concatenate([truth, drawn]).astype(np.uint16)
    gradient = {"embed": _scattered(contexts.ravel(), (error @ weights["turn"].T).reshape(-1, rule.dims), rule.classes + 1),
                "turn": seen.T @ error,
                "vector": _scattered(both, np.concatenate([up[:, None] * guess, down.T @ guess]), rule.classes),
                "bias": np.bincount(both, np.concatenate([up, down.sum(0)]), rule.classes).astype(np.float32)}
    for name, g in gradient.items():
        g /= np.sqrt(np.float32(n))
        squares[name] += g * g
        weights[name] -= np.float32(rule.rate) * g / np.sqrt(squares[name])


def train(state: np.ndarray, batches: Iterator[list[np.ndarray]], counts: np.ndarray, rule: Rule, seed: list[int]) -> tuple[int, np.ndarray]:
    """(tokens, new state) after one pass over lists of class sequences."""
    weights, squares = parts_of(state, rule)
    shares = noise_shares(counts)
    edges = np.cumsum(shares)
    log_noise = (np.log(rule.noise) + np.log(shares)).astype(np.float32)
    rng = np.random.default_rng(seed)
    tokens = 0
    for sequences in batches:
        if not sequences:
            continue
        padded, places = windows(sequences, rule)
        for at in range(0, len(places), rule.batch):
            some = places[at:at + rule.batch]
            drawn = np.minimum(np.searchsorted(edges, rng.random(rule.noise)), rule.classes - 1)
            nce_step(weights, squares, contexts_of(padded, some, rule), padded[some], drawn, log_noise, rule)
        tokens += len(places)
    return tokens, np.concatenate([x.ravel() for named in (weights, squares) for x in named.values()]).astype(np.float64)


def sequence_scores(weights: dict[str, np.ndarray], sequences: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Sum of ln p(class | context) over each sequence."""
    if not sequences:
        return np.zeros(0)
    padded, places = windows(sequences, rule)
    found, table = np.empty(len(places)), _class_table(weights)
    buffer, ones = np.empty((SCORED, rule.classes), np.float32), np.ones(rule.classes, np.float32)
    for at in range(0, len(places), SCORED):
        some = places[at:at + SCORED]
        z = np.matmul(_guesses(weights, contexts_of(padded, some, rule)), table, out=buffer[:len(some)])
        top = z.max(axis=1)
        true = z[np.arange(len(some)), padded[some]] - top
        np.subtract(z, top[:, None], out=z)
        found[at:at + SCORED] = true - np.log(np.exp(z, out=z) @ ones)
    return np.add.reduceat(found, np.cumsum([0] + [len(s) for s in sequences[:-1]]))


# --- tables ------------------------------------------------------------------

def _packed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(raw[8:], size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lower-cased words of all texts in a row, words of each text), by Arrow's kernels."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    whole = np.asarray(pc.binary_length(flat)) > 0
    ends = np.concatenate(([0], np.cumsum(whole)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return flat.filter(pa.array(whole)), np.diff(ends)


def numbered(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """Documents as word numbers, and the vocabulary of each part with its training counts.

    A document's row has id, held and numbers; a vocabulary's row first (its first word's number), words and counts.
    """
    ident = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"),
                         F.spark_partition_id().alias("task"))
    schema = f"part long, id {ident}, held boolean, numbers binary, first int, words array<string>, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        names = ["part", "id", "held", "numbers", "first", "words", "counts"]
        waiting, held_bytes, part = [], 0, 0

        def finished(number: int) -> Iterator[pa.RecordBatch]:
            """The documents and the vocabulary of one part."""
            words, sizes = zip(*(_words(piece.column("text")) for piece in waiting))
            coded = pa.concat_arrays(words).dictionary_encode()
            numbers, vocabulary = np.asarray(coded.indices).astype(np.uint32), coded.dictionary
            ends = np.cumsum(np.concatenate(sizes))
            learned = np.repeat(~np.concatenate([np.asarray(piece.column("held")) for piece in waiting]), np.concatenate(sizes))
            counts = np.bincount(numbers[learned], minlength=len(vocabulary))
            row = 0
            for piece in waiting:
                n = piece.num_rows
                packed = [_packed(numbers[ends[k - 1] if k else 0:ends[k]]) for k in range(row, row + n)]
                row += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), piece.column("id"), piece.column("held"), pa.array(packed, pa.binary()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            kind = waiting[0].column("id").type
            for at in range(0, len(vocabulary), ROW_WORDS):
                some = vocabulary.slice(at, ROW_WORDS)
                edges = pa.array([0, len(some)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([at], pa.int32()),
                     pa.ListArray.from_arrays(edges, some), pa.ListArray.from_arrays(edges, pa.array(counts[at:at + len(some)], pa.int64()))], names=names)

        task = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")[0].as_py()
            lengths, first = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)), 0
            while first < batch.num_rows:
                total = held_bytes + np.cumsum(lengths[first:])
                count = min(int(np.searchsorted(total, PART_BYTES)) + 1, batch.num_rows - first)
                waiting.append(batch.slice(first, count))
                held_bytes, first = int(total[count - 1]), first + count
                if held_bytes >= PART_BYTES:
                    yield from finished((task << 32) + part)
                    waiting, held_bytes, part = [], 0, part + 1
        if waiting:
            yield from finished((task << 32) + part)

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Counts:
    """Training counts: one row a known word, and the bounded facts that every task gets."""

    words: DataFrame          # word, c, class
    train_tokens: int
    known: int                # distinct tokens, the end included
    documents: int
    totals: np.ndarray        # tokens of each class
    sizes: np.ndarray         # known words of each class


def _class_of(word: Column, place: Column, rule: Rule) -> Column:
    return F.coalesce(place, F.lit(rule.words) + F.pmod(F.crc32(F.substring(word, -2, 2).cast("binary")), F.lit(rule.suffixes)).cast("int")).cast("int")


def count_words(rows: DataFrame, rule: Rule) -> Counts:
    """Counts over all training documents, from the parts' vocabularies."""
    spark = rows.sparkSession
    pairs = rows.where("words is not null").select(F.explode(F.arrays_zip("words", "counts")).alias("p")).select(F.col("p.words").alias("word"), F.col("p.counts").alias("n"))
    words = cut(pairs.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")))
    documents = rows.where("numbers is not null and not held").count()
    often = [(r["word"], place) for place, r in enumerate(words.orderBy(F.desc("c"), "word").limit(rule.words).collect())]
    placed = F.broadcast(spark.createDataFrame(often, "word string, place int"))
    classed = words.join(placed, "word", "left").select("word", "c", _class_of(F.col("word"), F.col("place"), rule).alias("class"))
    totals, sizes = np.zeros(rule.classes), np.zeros(rule.classes)
    for number, total, size in classed.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).collect():
        totals[number], sizes[number] = total, size
    totals[rule.end], sizes[rule.end] = documents, 1
    return Counts(classed, int(totals.sum()), int(sizes.sum()) - (documents == 0), documents, totals, sizes)


def classified(rows: DataFrame, counts: Counts, rule: Rule) -> DataFrame:
    """(id, held, n_tokens, n_known, base_score, within, classes): each document with its counts looked up.

    Scores are log10. ``within`` is the sum of log10 p(token | class); ``classes`` the sequence with its end.
    """
    ident = rows.schema["id"].dataType.simpleString()
    terms = rows.where("words is not null").select("part", "first", F.posexplode(F.arrays_zip("words")).alias("at", "p"))
    terms = terms.select("part", (F.col("first") + F.col("at")).alias("number"), F.col("p.words").alias("word"))
    group = _class_of(F.col("word"), F.col("known_class"), rule)
    found = terms.join(counts.words.withColumnRenamed("class", "known_class"), "word", "left").select(
        "part", "number", (F.coalesce("c", F.lit(0)) * rule.classes + group).alias("fact"), F.lit(None).cast(f"struct<id:{ident},held:boolean,numbers:binary>").alias("doc"))
    both = found.unionByName(rows.where("numbers is not null").select(
        "part", F.lit(DOCUMENT).alias("number"), F.lit(None).cast("long").alias("fact"), F.struct("id", "held", "numbers").alias("doc")))
    total, known, documents = counts.train_tokens, counts.known, counts.documents
    shares = counts.totals + 0.5 * (counts.sizes + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered = None, []
        classes = base = within = seen = np.zeros(0)
        end_base = np.log10((documents + 0.5) / (total + 0.5 * (known + 1)))

        def looked_up():
            c, group = np.divmod(np.concatenate(gathered) if gathered else np.zeros(0, np.int64), rule.classes)
            return (group, np.log10((c + 0.5) / (total + 0.5 * (known + 1))),
                    np.where(group < rule.words, 0.0, np.log10((c + 0.5) / shares[group])), c > 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = np.asarray(batch.column("part")), np.asarray(batch.column("number")) == DOCUMENT
            edges = np.flatnonzero(np.diff(part) | np.diff(kind)) + 1
            for first, last in zip([0, *edges], [*edges, batch.num_rows]):
                piece = batch.slice(first, last - first)
                if part[first] != now:
                    now, gathered, classes = part[first], [], None
                if not kind[first]:
                    gathered.append(np.asarray(piece.column("fact")))
                    continue
                if classes is None:
                    classes, base, within, seen = looked_up()
                    gathered = []
                out = []
                ids, held, numbers = piece.column("doc").flatten()
                for raw in numbers.to_pylist():
                    x = _unpacked(raw, np.uint32)
                    out.append((len(x) + 1, int(seen[x].sum()) + (documents > 0), float(base[x].sum() + end_base), float(within[x].sum()),
                                _packed(np.append(classes[x], rule.end).astype(np.uint16))))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids, held, *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                                                 names=["id", "held", "n_tokens", "n_known", "base_score", "within", "classes"])

    return both.repartition("part").sortWithinPartitions("part", "number").mapInArrow(
        run, f"id {ident}, held boolean, n_tokens long, n_known long, base_score double, within double, classes binary")


def _added(states: DataFrame) -> tuple[int, np.ndarray] | None:
    """(tokens, token-weighted sum of states) over one row a task, added up in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, None
        for batch in batches:
            for n, raw in zip(batch.column("tokens").to_pylist(), batch.column("state").to_pylist()):
                state = np.frombuffer(raw)
                tokens, total = tokens + n, state.copy() if total is None else total + state
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["tokens", "state"])

    tasks = states.count()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        states = cut(states.repartition(tasks).mapInArrow(run, states.schema))
    found = states.collect()
    if not found:
        return None
    return sum(r["tokens"] for r in found), sum(np.frombuffer(bytes(r["state"])) for r in found)


def fit(classes: DataFrame, counts: Counts, rule: Rule) -> np.ndarray:
    """The state after all rounds over (held, n_tokens, classes)."""
    totals = counts.totals

    state = start(rule, totals)
    for number in range(rule.rounds):
        def run(batches: Iterator[pa.RecordBatch], state=state, number=number) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return

            def sequences():
                yield [_unpacked(raw, np.uint16) for raw in first.column("classes").to_pylist()]
                for batch in batches:
                    yield [_unpacked(raw, np.uint16) for raw in batch.column("classes").to_pylist()]

            task = first.column("task")[0].as_py() if first.num_rows else 0
            tokens, after = train(state, sequences(), totals, rule, [SEED, number, task])
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(after * tokens).tobytes()], pa.binary())], names=["tokens", "state"])

        mine = classes.where(~F.col("held") & (F.pmod(F.xxhash64("classes"), F.lit(rule.rounds)) == number))
        trainers = 1 + counts.train_tokens // rule.rounds // TRAINER_TOKENS
        mine = mine.coalesce(trainers).select("classes", F.spark_partition_id().alias("task"))
        states = cut(mine.mapInArrow(run, "tokens long, state binary"))
        found = _added(states)
        if found:
            state = found[1] / found[0]
    return state


def score_documents(docs: DataFrame, held_out: Column, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities of the text."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lm-scoring")
    numbered(docs, held_out, id_col, text_col).write.parquet(f"{path}/numbered")
    rows = spark.read.parquet(f"{path}/numbered")
    counts = count_words(rows, rule)
    # dealt anew, so that training and scoring have even tasks whatever the number of parts
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classified(rows, counts, rule).repartition(tasks).write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    state = fit(classes, counts, rule)
    ident = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = parts_of(state, rule)
        for batch in batches:
            scores = sequence_scores(weights, [_unpacked(raw, np.uint16) for raw in batch.column("classes").to_pylist()], rule)
            kept = ["id", "held", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(scores / np.log(10) + np.asarray(batch.column("within")), pa.float64())],
                                             names=[*kept, "score"])

    out = classes.mapInArrow(run, f"id {ident}, held boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(counts.train_tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")
