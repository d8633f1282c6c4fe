"""Command line: ``python -m tessera study --data upload.csv --out results/``.

Runs the end-to-end study with the plot-observation spec and writes every
report table.
"""

from __future__ import annotations

import argparse

from tessera.session import get_spark


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tessera")
    sub = ap.add_subparsers(dest="cmd", required=True)
    st = sub.add_parser("study", help="validate, profile, cross-validate, compare and test models")
    st.add_argument("--data", help="CSV or parquet file (default: newest file of --data-dir)")
    st.add_argument("--data-dir", default="data/raw")
    st.add_argument("--out", required=True)
    st.add_argument("--key", default=None, help="row key column (default: md5 over all columns and the number of the copy)")
    st.add_argument("--folds", type=int, default=5)
    st.add_argument("--seed", type=int, default=42)
    st.add_argument("--max-iter", type=int, default=60)
    st.add_argument("--tuning-trials", type=int, default=0)
    args = ap.parse_args(argv)

    from pyspark.sql import functions as F

    from tessera.plans.study import run_study
    from tessera.sources import files
    from tessera.spec import IRRIGATION_SPEC

    spark = get_spark()
    path = args.data or files.newest_file(spark, args.data_dir)
    df = files.read_table(spark, path)
    key = args.key
    if key is None:
        key = "row_key"
        cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        # copies of a row get keys of their own: counted once per distinct row, then one key for each
        copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
        df = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__n") \
            .withColumn(key, F.md5(F.concat_ws("|", cells, "__copy"))).drop("__copy")
    res = run_study(df, IRRIGATION_SPEC, key, args.folds, args.seed, max_iter=args.max_iter,
                    tuning_trials=args.tuning_trials, out_dir=args.out)
    print(f"best model: {res.best_model}; excluded rows: {res.excluded_rows}; warnings: {res.warnings}")


if __name__ == "__main__":
    main()
