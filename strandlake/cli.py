"""Command line: build, count, exists, locate, region-count, region-exists, info, verify, reconstruct, version, help.

Exit status 0 if all went well, 1 after any error.
"""

from __future__ import annotations

import argparse
import json
import sys

from strandlake import __version__
from strandlake.functions.patterns import LAST, Region, parse_region
from strandlake.schema import BuildConfig, EngineError, ErrorCode, Overlap, Strand


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    sub = top.add_subparsers(dest="command")
    build = sub.add_parser("build")
    build.add_argument("inputs", nargs="+", help="BAM, SAM or Parquet files or folders")
    build.add_argument("-o", "--output", default="output.index")
    build.add_argument("--window-size", type=int, default=100_000)
    build.add_argument("--quality-codec", default="RANGE_CYCLE")
    build.add_argument("--quality-bins", type=int, default=0)
    build.add_argument("--strand", choices=[s.value for s in Strand], default="complete")
    build.add_argument("--overlap", choices=[o.value for o in Overlap], default="all")
    build.add_argument("--block-size", type=int, default=1024)
    build.add_argument("--word-size", type=int, default=0, help="also write postings of words of so many bases")
    build.add_argument("--enhanced", action="store_true")
    build.add_argument("--bidirectional", action="store_true")
    for name in ("count", "exists", "locate", "region-count", "region-exists"):
        p = sub.add_parser(name)
        p.add_argument("index")
        p.add_argument("pattern")
        p.add_argument("--strand", choices=[s.value for s in Strand])
        p.add_argument("--approx", type=int)
        if name == "count":
            p.add_argument("--overlap", choices=[o.value for o in Overlap])
            p.add_argument("--benchmark", action="store_true")
        if name in ("exists", "region-exists"):
            p.add_argument("--threshold", type=int, default=1)
        if name == "locate":
            p.add_argument("--format", choices=["tsv", "bed", "json", "jsonl"], default="tsv")
            p.add_argument("--streaming", action="store_true", help="as found, without sorting")
            p.add_argument("--limit", type=int)
            p.add_argument("-o", "--output")
        if name.startswith("region"):
            p.add_argument("--region")
            p.add_argument("--chrom")
            p.add_argument("--start", type=int, default=0)
            p.add_argument("--end", type=int, default=LAST)
    info = sub.add_parser("info")
    info.add_argument("index")
    info.add_argument("--text", action="store_true")
    info.add_argument("--bwt", action="store_true", help="also compute runs of the Burrows-Wheeler transform")
    verify = sub.add_parser("verify")
    verify.add_argument("index")
    verify.add_argument("--strict", action="store_true")
    rec = sub.add_parser("reconstruct")
    rec.add_argument("index")
    rec.add_argument("-o", "--output", required=True)
    rec.add_argument("--format", choices=["bam", "sam", "parquet"], default="bam")
    rec.add_argument("--streams")
    rec.add_argument("--read-ids")
    rec.add_argument("--allow-lossy", action="store_true")
    sub.add_parser("version")
    sub.add_parser("help")
    return top


def _load(spark, inputs: list[str]):
    from strandlake.sources.alignment_files import register

    register(spark)
    kinds = {"bam": [], "sam": [], "parquet": []}
    for path in inputs:
        kinds["bam" if path.endswith("bam") else "sam" if path.endswith("sam") else "parquet"].append(path)
    if sum(map(bool, kinds.values())) != 1:
        raise EngineError(ErrorCode.INVALID_BAM_INPUT, "give files of one kind")
    kind, paths = next((k, p) for k, p in kinds.items() if p)
    return spark.read.parquet(*paths) if kind == "parquet" else spark.read.format(kind).load(",".join(paths))


def run(args: argparse.Namespace, out=sys.stdout) -> None:
    from strandlake.functions.digests import manifest
    from strandlake.plans.index import ReadIndex
    from strandlake.session import local_session, ship
    from strandlake.sources import sinks
    from strandlake.sources.alignment_files import header_bytes, header_contigs, register

    say = lambda x: print(json.dumps(x), file=out)
    if getattr(args, "approx", None) is not None:
        raise EngineError(ErrorCode.NOT_IMPLEMENTED, "approximate matching")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    if args.command == "build":
        config = BuildConfig(window_size=args.window_size, quality_codec=args.quality_codec, quality_bins=args.quality_bins, strand=Strand(args.strand), enhanced=args.enhanced, word_size=args.word_size, overlap=Overlap(args.overlap), block_size=args.block_size, bidirectional=args.bidirectional)
        files = [p for p in args.inputs if p.endswith(("bam", "sam"))]
        digest = manifest([(p, header_bytes(p)) for p in files]) if files else ""
        names = [n for p in files for n, _ in header_contigs(p)]
        say(ReadIndex.build(spark, _load(spark, args.inputs), args.output, config, manifest=digest, header_contigs=names).info)
        return
    index = ReadIndex(spark, args.index)
    strand = Strand(args.strand) if getattr(args, "strand", None) else None
    if args.command == "count":
        say(index.timed_count(args.pattern, strand) if args.benchmark else {"count": index.count(args.pattern, strand, Overlap(args.overlap) if args.overlap else None)})
    elif args.command == "exists":
        say({"exists": index.exists(args.pattern, args.threshold, strand)})
    elif args.command == "locate":
        found = index.locate(args.pattern, strand, not args.streaming, args.limit)
        shaped = {"tsv": sinks.tsv, "bed": sinks.bed, "json": sinks.json_lines, "jsonl": sinks.json_lines}[args.format](found)
        if args.output:
            shaped.write.text(args.output) if args.format.startswith("json") else sinks.write_tsv(shaped, args.output, args.format == "tsv")
        elif args.format == "json":
            for piece in sinks.json_pieces(found, "streaming" if args.streaming else "sorted"):
                out.write(piece)
            out.write("\n")
        else:
            if args.format == "tsv":
                print("\t".join(shaped.columns), file=out)
            for row in shaped.toLocalIterator():
                print("\t".join(map(str, row)), file=out)
    elif args.command in ("region-count", "region-exists"):
        if not (args.region or args.chrom):
            raise EngineError(ErrorCode.INVALID_REGION, "a region is needed")
        region = parse_region(args.region) if args.region else Region(args.chrom, args.start, args.end)
        tail = {"mode": index.info["mode"], "strand_mode": (strand or index.strand).value}
        if args.command == "region-count":
            say({"region_count": index.region_count(args.pattern, region, strand), **tail})
        else:
            say({"region_exists": index.region_exists(args.pattern, region, args.threshold, strand), **tail})
    elif args.command == "info":
        facts = index.document(args.bwt)
        if args.text:
            for k, v in facts.items():
                print(f"{k + ':':<26}{json.dumps(v) if isinstance(v, (list, bool)) else v}", file=out)
        else:
            say(facts)
    elif args.command == "verify":
        good = index.verify(args.strict)
        say({"valid": good, "strict": args.strict})
        if not good:
            raise EngineError(ErrorCode.CHECKSUM_MISMATCH, args.index)
    elif args.command == "reconstruct":
        ids = [int(x) for x in args.read_ids.split(",")] if args.read_ids else None
        rows = index.reconstruct(args.streams.split(",") if args.streams else None, ids, args.allow_lossy)
        if args.format == "parquet":
            rows.write.mode("overwrite").parquet(args.output)
        else:
            register(spark)
            contigs = [(r["chrom"], 999_999_999) for r in index.contigs.orderBy("chrom_id").collect()]  # the file's header
            kept = rows.drop("read_id", "request")
            kept.write.format(args.format).mode("append").option("contigs", json.dumps(contigs)).save(args.output)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = _parser()
    if not argv or argv[0] in ("help", "--help", "-h"):
        parser.print_help()
        return 0
    if argv[0] in ("version", "--version"):
        print(__version__)
        return 0
    try:
        run(parser.parse_args(argv))
        return 0
    except EngineError as e:
        print(e, file=sys.stderr)
    except SystemExit:
        pass
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
