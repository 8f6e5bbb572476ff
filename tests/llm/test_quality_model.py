import numpy as np

from rulemill.llm.quality_model import N_FEATURES, PASSAGE_WORDS, Network, passages, score, train, training_sample


def test_passages_cover_the_whole_text(prose):
    text = (prose(3 * PASSAGE_WORDS + 5) + " LOUD!! 12 #").encode()
    bag = passages(text)
    assert bag.shape == (4, N_FEATURES) and np.isfinite(bag).all() and bag[-1, 0] > 0 and not bag[:3, 0].any()
    assert not passages(None).any() and passages(b" \n ").shape == (1, N_FEATURES)
    assert passages(b"  one\n\n two ")[0, 6] == 1.0  # two line feeds to two words
    assert len(passages(b"w " * 100_000)) == -(-100_000 // PASSAGE_WORDS)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net, x, starts, target = Network(), rng.normal(size=(9, N_FEATURES)).astype(np.float32), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -(target * np.log((y := net.forward(x, starts)["y"])) + (1 - target) * np.log(1 - y)).mean()
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    grads = net.gradients(net.forward(x, starts), starts, target)
    for name, w in net.p.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_attention_finds_the_passage():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(300):
        bag = rng.normal(size=(int(rng.integers(1, 8)), N_FEATURES)).astype(np.float32)
        if k % 2:
            bag[rng.integers(len(bag)), 0] += 6
        bags.append(bag)
        labels.append(k % 2)
    net = Network().fit(bags[:200], np.array(labels[:200], np.float32), epochs=30)
    right = hit = 0
    for bag, label in zip(bags[200:], labels[200:]):
        f = net.forward(bag, np.zeros(1, np.int64))
        right += (f["y"][0] > 0.5) == label
        hit += label and int(np.argmax(f["a"])) == int(np.argmax(bag[:, 0]))
    assert right >= 90 and hit >= 35


def test_sample_is_bounded_and_votes(spark):
    labels = [(i, i % 2) for i in range(100)] + [(1, 0), (1, 0), (None, 1), (2, None)]
    rows = training_sample(spark.createDataFrame(labels, "doc_id long, label int"), 10).collect()
    assert sorted(r["label"] for r in rows) == [0] * 10 + [1] * 10
    every = {r["doc_id"]: r["label"] for r in training_sample(spark.createDataFrame(labels, "doc_id long, label int"), 1000).collect()}
    assert every[1] == 0 and len(every) == 100


def test_awkward_rows(spark, awkward, no_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(201, 0), (999, 1)], "doc_id long, label int")
    net = train(awkward, labels, epochs=2)
    rows = score(awkward, net).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score(no_rows, net).collect() == []
    plain = train(no_rows, labels, epochs=2)
    assert {r["score"] for r in score(awkward, plain).collect()} == {0.5}


def test_held_out_accuracy(spark):
    from rulemill.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_attention_quality"](spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    right = [r["predicted"] == r["quality"] for r in got.filter("held_out").collect()]
    assert sum(right) / len(right) > 0.95
