"""Command line: ``save`` builds the index and searches it, ``load`` searches one that is there."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .functions.encoder import PRESETS, Encoder, model_files
from .functions.text import fix_query
from .operators.batching import BATCH, embed
from .operators.search import MIN_P, TOP_K, presented, search
from .progress import counted, init_log
from .shared import written
from .sources.captions import chunks_of, find_files
from .sources.index import read_index, write_index
from .sources.safetensors import SafeTensors
from .sources.vocab import load_vocab

log = logging.getLogger("cuesift")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuesift", description=__doc__)
    p.add_argument("action", choices=["load", "save"])
    p.add_argument("-m", "--model", choices=list(PRESETS), default="mini-lm")
    p.add_argument("-q", "--query", required=True)
    p.add_argument("-b", "--batch", type=int, default=BATCH)
    p.add_argument("-k", "--top-k", type=int, default=TOP_K, help="0 for no limit")
    p.add_argument("-p", "--min-p", type=float, default=MIN_P, help="depends on the model")
    p.add_argument("--subs", default="subs", help="folder of <channel>/raw/<caption files>")
    p.add_argument("--index", default=".embeddings")
    p.add_argument("--weights", help="in place of the model's own file")
    p.add_argument("--vocab", help="in place of the model's own file")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> list[tuple[int, str, str, str]]:
    weights, vocab_path, config = model_files(args.model)
    weights, vocab = args.weights or weights, load_vocab(args.vocab or vocab_path)
    if args.action == "save":
        paths = find_files(args.subs)
        with counted(spark.sparkContext, "files", len(paths)) as done:
            chunks = written(chunks_of(spark, paths, done=done), "chunks")
        with counted(spark.sparkContext, "chunks", chunks.count()) as done:
            write_index(embed(chunks, vocab, weights, config, args.batch, done=done), args.index, args.model, config.hidden, mode="overwrite")
    index = read_index(spark, args.index, args.model)
    query = fix_query(args.query)
    vector = Encoder(SafeTensors(weights).all(), config).embed([vocab.encode(query)])[0].tolist()
    found = presented(search(index, vector, args.top_k, args.min_p), index)
    return [tuple(r) for r in found.toLocalIterator()]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    init_log()
    spark = SparkSession.builder.appName("cuesift").getOrCreate()
    log.info("searching: %s", args.query)
    for rank, score, url, text in run(spark, args):
        log.info("rank=%s score=%s vod=%s", rank, score, url)
        print(f"{text}\n")


if __name__ == "__main__":
    main()
