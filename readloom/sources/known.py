"""Known adapters and primers of public sequencing kits, made by rule from their barcodes.

An indexed oligonucleotide is a head, a barcode and a tail; the barcodes are listed once and each family is a rule.
"""

from __future__ import annotations

# Published sequences of the vendors.

#: The parts that indexed oligonucleotides share.
READ_1_END = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC"
SMALL_RNA_END = "TGGAATTCTCGGGTGCCAAGGAACTCCAGTCAC"
P7_TAIL = "ATCTCGTATGCCGTCTTCTGCTTG"
P7_HEAD = "CAAGCAGAAGACGGCATACGAGAT"
P7_PRIMER = "GTGACTGGAGTTC"
RNA_PRIMER = "CTTGGCACCCGAGAATTCCA"
NEXTERA_I7 = "CCGAGCCCACGAGAC"
NEXTERA_I5 = "GACGCTGCCGACGA"
P5_TAIL = "GTGTAGATCTCGGTGGTCGCCGTATCATT"

#: Six-base indices 1 to 48.
INDEX_6 = (
    "ATCACG CGATGT TTAGGC TGACCA ACAGTG GCCAAT CAGATC ACTTGA GATCAG TAGCTT GGCTAC CTTGTA "
    "AGTCAA AGTTCC ATGTCA CCGTCC GTAGAG GTCCGC GTGAAA GTGGCC GTTTCG CGTACG GAGTGG GGTAGC "
    "ACTGAT ATGAGC ATTCCT CAAAAG CAACTA CACCGG CACGAT CACTCA CAGGCG CATGGC CATTTT CCAACA "
    "CGGAAT CTAGCT CTATAC CTCAGA GACGAC TAATCG TACAGC TATAAT TCATTC TCCCGA TCGAAG TCGGCA"
).split()
#: Eight-base forms of the indices from 13 on that have one.
INDEX_8 = {13: "AGTCAACA", 14: "AGTTCCGT", 15: "ATGTCAGA", 16: "CCGTCCCG", 18: "GTCCGCAC", 19: "GTGAAACG", 20: "GTGGCCTT", 21: "GTTTCGGA", 22: "CGTACGTA", 23: "GAGTGGAT", 25: "ACTGATAT", 27: "ATTCCTTT"}
#: The seven bases of index 23 in its catalogued form.
INDEX_23_SHORT = "CCACTCT"
N7 = {
    701: "TAAGGCGA", 702: "CGTACTAG", 703: "AGGCAGAA", 704: "TCCTGAGC", 705: "GGACTCCT", 706: "TAGGCATG", 707: "CTCTCTAC", 708: "CAGAGAGG", 709: "GCTACGCT", 710: "CGAGGCTG", 711: "AAGAGGCA",
    712: "GTAGAGGA", 714: "GCTCATGA", 715: "ATCTCAGG", 716: "ACTCGCTA", 718: "GGAGCTAC", 719: "GCGTAGTA", 720: "CGGAGCCT", 721: "TACGCTGC", 722: "ATGCGCAG", 723: "TAGCGCTC", 724: "ACTGAGCG",
    726: "CCTAAGAC", 727: "CGATCAGT", 728: "TGCAGCTA", 729: "TCGACGTC",
}
S5 = {
    501: "GCGATCTA", 502: "ATAGAGAG", 503: "AGAGGATA", 504: "TCTACTCT", 505: "CTCCTTAC", 506: "TATGCAGT", 507: "TACTCCTT", 508: "AGGCTTAG", 510: "ATTAGACG", 511: "CGGAGAGA", 513: "CTAGTCGA",
    515: "AGCTAGAA", 516: "ACTCTAGG", 517: "TCTTACGC", 518: "CTTAATAG", 520: "ATAGCCTT", 521: "TAAGGCTC", 522: "TCGCATAA",
}

#: name, R1's sequence and R2's, where it differs. The three that lead are tried first where scores are equal.
LEADING = (
    ("illumina-truseq", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"),
    ("nextera", "CTGTCTCTTATACACATCT", None),
    ("small-rna", "TGGAATTCTCGGGTGCCAAGG", "GATCGTCGGACTGTAGAACTCTGAACGTGTAGA"),
)
SINGLE = {
    "abi-solid3-adapter-a": "CTGCCCCGGGTTCCTCATTCTCTCAGCAGCATG",
    "abi-solid3-adapter-b": "CCACTACGCCTCCGCTTTCCTCTCTATGGGCAGTCGGTGAT",
    "clontech-universal-primer-mix-long": "CTAATACGACTCACTATAGGGCAAGCAGTGGTATCAACGCAGAGT",
    "illumina-expression-pcr-primer-2": "AATGATACGGCGACCACCGACAGGTTCAGAGTTCTACAGTCCGA",
    "illumina-flow-cell-1": "TTTTTTTTTTAATGATACGGCGACCACCGAGATCTACAC",
    "illumina-flow-cell-2": "TTTTTTTTTTCAAGCAGAAGACGGCATACGA",
    "illumina-nlaiii-sequencing-primer": "CCGACAGGTTCAGAGTTCTACAGTCCGACATG",
    "illumina-paired-end-adapter-1": "ACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "illumina-paired-end-adapter-2": "GATCGGAAGAGCGGTTCAGCAGGAATGCCGAG",
    "illumina-paired-end-pcr-primer-2": "CAAGCAGAAGACGGCATACGAGATCGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT",
    "illumina-paired-end-sequencing-primer-2": "CGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT",
    "illumina-pcr-dimer": "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCTAGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTG",
    "illumina-pcr-primer-pair": "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCTCAAGCAGAAGACGGCATACGAGCTCTTCCGATCT",
    "illumina-prefix-pe-1": "TACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "illumina-prefix-pe-2": "GTGACTGGAGTTCAGACGTGTGCTCTTCCGATCT",
    "illumina-rna-pcr-primer": "AATGATACGGCGACCACCGAGATCTACACGTTCAGAGTTCTACAGTCCGA",
    "illumina-rna-pcr-primer-rp1": "TCGGACTGTAGAACTCTGAACGTGTAGATCTCGGTGGTCGCCGTATCATT",
    "illumina-single-end-adapter-1": "GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG",
    "illumina-single-end-adapter-2": "CAAGCAGAAGACGGCATACGAGCTCTTCCGATCT",
    "illumina-small-rna-sequencing-primer": "CGACAGGTTCAGAGTTCTACAGTCCGACGATC",
    "nextera-i5-adapter": "CTGATGGCGCGAGGGAGGCGTGTAGATCTCGGTGGTCGCCGTATCATT",
    "nextera-i5-transposase-1": "CTGTCTCTTATACACATCTGACGCTGCCGACGA",
    "nextera-i5-transposase-2": "CTGTCTCTTATACACATCTCTGATGGCGCGAGGGAGGC",
    "nextera-i7-adapter-no-barcode": "CTGAGCGGGCTGGCAAGGCAGACCGATCTCGTATGCCGTCTTCTGCTTG",
    "nextera-i7-transposase-1": "CTGTCTCTTATACACATCTCCGAGCCCACGAGAC",
    "nextera-i7-transposase-2": "CTGTCTCTTATACACATCTCTGAGCGGGCTGGCAAGGC",
    "nextera-lmp-read-1-external-adapter": "GATCGGAAGAGCACACGTCTGAACTCCAGTCAC",
    "nextera-lmp-read-2-external-adapter": "GATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "nextera-transposase-1": "TCGTCGGCAGCGTCAGATGTGTATAAGAGACAG",
    "nextera-transposase-2": "GTCTCGTGGGCTCGGAGATGTGTATAAGAGACAG",
    "pcr-primer-1-reverse-complement": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCTCGGTGGTCGCCGTATCATT",
    "pcr-primer-2-reverse-complement": "AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTG",
    "phix-read-1-adapter": "AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTGAAA",
    "phix-read-2-adapter": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCTCGGTGGTCGCCGTATCATTAAAAAA",
    "truseq-reverse-adapter": "AGATCGGAAGAGCACACGTCTGAACTCCAGTCACATCACGATCTCGTATGCCGTCTTCTGCTTG",
    "truseq-universal-adapter": "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "truseq2-paired-end-reverse": "AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAG",
    "truseq2-single-end": "AGATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG",
    "truseq3-indexed-adapter": "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC",
    "truseq3-universal-adapter": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTA",
}
TRAILING = (
    ("mgi-bgi-forward", "AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA", None),
    ("mgi-bgi-reverse", "AAGTCGGATCGTAGCCATGTCGTTCTGTGAGCCAAGGAGTTG", None),
    ("qiaseq-mirna", "AACTGTAGGCACCATCAAT", None),
)

# End of the fixed values.


def _reverse_complement(x: str) -> str:
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


def indexed() -> dict[str, str]:
    """The families, by name."""
    out: dict[str, str] = {}
    truseq = READ_1_END[1:]
    for n, six in enumerate(INDEX_6, 1):
        primer = P7_HEAD + _reverse_complement(six) + P7_PRIMER
        out[f"illumina-rna-pcr-primer-index-{n}"] = primer + RNA_PRIMER
        out[f"illumina-rna-pcr-primer-rpi-{n}"] = SMALL_RNA_END + six + P7_TAIL
        if n <= 12:
            out[f"illumina-pcr-primer-index-{n}"] = primer
            out[f"truseq-adapter-index-{n}"] = truseq + six + P7_TAIL
    for n, eight in INDEX_8.items():
        # the plain form ends after seven bases and shares the tail's first with the eighth
        short = INDEX_23_SHORT if n == 23 else eight[:7]
        out[f"truseq-adapter-index-{n}"] = truseq + short + P7_TAIL[1:]
        out[f"truseq-adapter-index-{n}-variant"] = truseq + eight + P7_TAIL
    out |= {f"nextera-i7-primer-n{n}": NEXTERA_I7 + x + P7_TAIL for n, x in N7.items()}
    out |= {f"nextera-i5-primer-s{n}": NEXTERA_I5 + x + P5_TAIL for n, x in S5.items()}
    return out


def entries() -> list[tuple[str, str, str | None]]:
    """name, R1 and R2 of all: the leading ones, then the rest in order of their sequence, then the trailing ones."""
    middle = sorted((seq, name) for name, seq in (SINGLE | indexed()).items())
    return [*LEADING, *((name, seq, None) for seq, name in middle), *TRAILING]
