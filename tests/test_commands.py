"""The commands one after the other, as a user would run them."""

from genoquery.__main__ import main
from genoquery.plans.fixture import genotypes, pedigrees
from genoquery.sources import vcf


def read(spark, path):
    return [r["value"].split("\t") for r in spark.read.text(path).collect()]


def test_from_vcf_to_parents(spark, small, tmp_path):
    at = lambda n: str(tmp_path / n)
    vcf.from_genotypes(genotypes(spark, small)).orderBy("k").select("value").write.text(at("vcf"))
    pedigrees(spark, small).na.fill("NA").selectExpr("concat_ws('\t', prog, fpar, mpar) as value").write.text(at("ped"))
    main(["matrix", "--input", at("vcf"), "--output", at("m"), "--rejected", at("bad")])
    main(["duplicates", "--input", at("m"), "--output", at("pairs"), "--distance-max", "0.2"])
    main(["clusters", "--input", at("pairs"), "--output", at("clusters")])
    main(["clusters", "--input", at("pairs"), "--output", at("full"), "--full-output", "--cluster-distance", "0.2"])
    main(
        [
            "uniquify", "--clusters", at("clusters"), "--input", at("m"), "--output", at("u"), "--pedigrees", at("ped"),
            "--pedigrees-output", at("uped")
        ]
    )
    main(["uniquify", "--clusters", at("full"), "--input", at("m"), "--output", at("v"), "--vote"])
    main(["parents", "--input", at("u"), "--pedigrees", at("uped"), "--output", at("out"), "--alternative-pedigrees-level", "2"])
    main(["histogram", "--input", at("pairs"), "--columns", "5u6", "--output", at("h"), "--binwidth", "0.02"])
    everyone = genotypes(spark, small).select("acc_id").distinct().count()
    found = read(spark, at("clusters"))
    assert len(read(spark, at("m"))) == everyone + 2 and read(spark, at("m"))[0][0] == "MARKER" and len(read(spark, at("bad"))) == 2
    assert all(len(r) == 9 + int(r[0]) for r in found) and all(len(r) == 9 + 3 * int(r[0]) for r in read(spark, at("full")))
    assert len(read(spark, at("u"))) == everyone + 2 - sum(int(r[0]) - 1 for r in found)
    assert len(read(spark, at("v"))) == everyone + 2 - sum(int(r[0]) - 1 for r in read(spark, at("full")))
    kinds = {r[1] for r in read(spark, at("out"))}
    assert kinds == {"P", "A"} and read(spark, at("h"))


def test_whole_runs_equal_their_steps(spark, small, tmp_path):
    at = lambda n: str(tmp_path / n)
    vcf.from_genotypes(genotypes(spark, small)).orderBy("k").select("value").write.text(at("vcf"))
    pedigrees(spark, small).na.fill("NA").selectExpr("concat_ws('\t', prog, fpar, mpar) as value").write.text(at("ped"))
    chosen = ["--maf-min", "0.05", "--marker-max-missing-data", "0.25", "--accession-max-missing-data", "0.5"]
    main(
        [
            "vcf-to-parents", "--input", at("vcf"), "--pedigrees", at("ped"), "--output", at("w1"), "--alternative-pedigrees-level", "2",
            *chosen
        ]
    )
    main(["duplicate-finder", "--input", at("vcf"), "--output", at("w2"), "--cluster-distance", "0.035", *chosen])
    main(["duplicates", "--input", at("vcf"), "--output", at("pairs"), "--filtered-out", at("m"), *chosen])
    main(["clusters", "--input", at("pairs"), "--output", at("clusters")])
    main(
        [
            "uniquify", "--clusters", at("clusters"), "--input", at("m"), "--output", at("u"), "--pedigrees", at("ped"),
            "--pedigrees-output", at("uped")
        ]
    )
    main(
        [
            "parents", "--input", at("u"), "--pedigrees", at("uped"), "--output", at("out"), "--alternative-pedigrees-level", "2",
            "--maf-min", "0", "--marker-max-missing-data", "1", "--accession-max-missing-data", "1"
        ]
    )
    step = [[r[0], r[2], *r[4:]] for r in read(spark, at("pairs"))]
    assert read(spark, at("w1/pairs")) == read(spark, at("w2/pairs")) == step and step
    assert read(spark, at("w1/clusters")) == read(spark, at("w2/clusters")) == read(spark, at("clusters"))
    assert sorted(
        read(spark, at("w1/unique"))
    ) == sorted(read(spark, at("u"))) and read(spark, at("w1/pedigrees")) == read(spark, at("uped"))
    assert read(spark, at("w1/parents")) == read(spark, at("out"))
    main(["duplicate-finder", "--input", at("vcf"), "--output", at("auto")])
    assert read(spark, at("auto/histogram"))
