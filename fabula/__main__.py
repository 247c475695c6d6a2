"""python -m fabula --book BOOK [--chapter N | --all-chapters] [--skip-tts] [--workers N] [--openai-model M] [--no-narrator-tone] [--stand-ins]"""

from __future__ import annotations

import argparse

from .operators import annotate, synth
from .plans import narrate
from .sources import config, providers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fabula", description="Turn books into narrated chapters.")
    p.add_argument("--book", required=True, help="an EPUB file, or a folder of them")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--chapter", type=int, default=1, help="number of the chapter, from 1")
    which.add_argument("--all-chapters", action="store_true", help="all chapters whose output isn't there yet")
    p.add_argument("--skip-tts", action="store_true", help="annotate only")
    p.add_argument("--workers", type=int, default=2, help="tasks that synthesize at a time")
    p.add_argument("--openai-model", default=config.model_name(), help="model of the annotation provider")
    p.add_argument("--narrator-tone", action=argparse.BooleanOptionalAction, default=True, help="one tone for all narration of a chapter")
    p.add_argument("--stand-ins", action="store_true", help="rules and tones in place of models, to try things out; their results are kept apart")
    return p


def settings(argv: list[str] | None = None) -> narrate.Settings:
    p = parser()
    args = p.parse_args(argv)
    if args.workers < 1:
        p.error("--workers must be at least 1")
    if args.stand_ins:
        provider, voice = annotate.RuleProvider(), synth.ToneVoice()
    else:
        # a model that isn't there is an error, never replaced by something else
        if not providers.available("openai"):
            p.error("annotation needs the openai library (or --stand-ins)")
        if not args.skip_tts and not providers.available("torch", "qwen_tts"):
            p.error("speech needs the torch and qwen_tts libraries (or --skip-tts, or --stand-ins)")
        provider, voice = providers.ChatProvider(args.openai_model), None if args.skip_tts else providers.SpeechModel(args.workers)
    return narrate.Settings(
        books=args.book, provider=provider, voice=voice, chapter=None if args.all_chapters else args.chapter, skip_tts=args.skip_tts, workers=args.workers, narrator_tone=args.narrator_tone, say=lambda x: print(x, flush=True),
    )


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    s = settings(argv)
    # a call of a model mustn't be made twice because a task is slow
    spark = SparkSession.builder.appName("fabula").config("spark.speculation", "false").getOrCreate()
    written = narrate.run(spark, s)
    for r in written.orderBy("book_id", "chapter_number").collect() if written is not None else []:
        print(f"{r['path']}: {r['n_samples']} samples")


if __name__ == "__main__":
    main()
