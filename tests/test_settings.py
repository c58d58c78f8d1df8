from reelmill.settings import TIER_MBPS, Settings, density


def test_densities_are_the_tiers_anchors():
    assert [round(density(t), 4) for t in TIER_MBPS] == [0.0965, 0.1286, 0.1688, 0.2090, 0.2492]


def test_signature_changes_only_with_what_it_covers():
    base = Settings()
    assert base.signature() == "EXCELLENT|h265|rmx1|xc1|inplace"
    assert Settings(tier_bpp={"EXCELLENT": density("EXCELLENT")}).signature() == base.signature()
    assert Settings(tier_bpp={"EXCELLENT": 0.12}).signature().endswith("|bpp0.12000")
    assert Settings(encoder="software").signature().endswith("|encsoftware")
    assert Settings(min_saving_ratio=0.5, tolerance=1.3, container="mkv").signature() == base.signature()


def test_unreadable_overrides_fall_back():
    for bad in ("x", None, 0, -1):
        assert Settings(tier_bpp={"EXCELLENT": bad}).bpp == density("EXCELLENT")


def test_problems():
    assert not Settings().problems()
    found = Settings(tier="BAD", output_mode="separate", min_saving_ratio=0, jobs=0).problems()
    assert len(found) == 4
    assert Settings(source_action="keep").problems()


def test_answers_are_clamped_and_junk_is_passed_over():
    s = Settings.of({"tier": "good", "codec": "H264", "jobs": "-3", "min_saving_ratio": "oops", "ignore_exts": "avi", "nonsense": 1, "remux_to_mp4": "no", "container": "ogg"})
    assert (s.tier, s.codec, s.jobs, s.min_saving_ratio, s.ignore_exts, s.remux_to_mp4, s.container) == ("GOOD", "h264", 1, 0.75, ("avi",), False, "auto")
    assert s.has_ignore_rules and not s.needs_size_to_ignore


def test_each_answer_has_its_own_range():
    s = Settings.of({"floor_kbps": 5, "tolerance": "9", "hevc": [0.1, "x", 2], "audio_kbps_stereo": 9999, "jobs": 99, "tier_bpp": {"good": 7, "OK": "x", "excellent": density("EXCELLENT"), "none": 1}, "sub_kinds": ["hoh", "forced", "normal"], "output_dir": "/out", "tier": None})
    assert (s.floor_kbps, s.tolerance, s.hevc, s.audio_kbps_stereo, s.jobs, s.tier_bpp, s.sub_kinds, s.output_dir, s.tier) == (200, 2.0, (0.2, 0.50, 1.0), 640, 16, {"GOOD": 1.0}, (), "/out", "EXCELLENT")
    assert Settings.of({"sub_kinds": ["hoh", "odd"], "hevc": 3, "tier_bpp": 4}) == Settings(sub_kinds=("hoh",))
