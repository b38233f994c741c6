"""Fixed values: (license_id, SHA-256, length in bytes) of the canonical forms of whole licences: entire, without the title line, and without what follows the terms."""

DIGESTS = [
    ("Apache-2.0", "1d2490e65bade4b7cde700178105759a1eeb6ed401841c01b9ff35e40e55c5ad", 8657),
    ("Apache-2.0", "83c751dfe33b6bcf56055b71330745f1103cac80bc38605cb26988b890503f77", 9686),
    ("Apache-2.0", "8f8645cb16bf3bd454e08bf08d894dd5834b60f876c53d63043e71e587563aeb", 8642),
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca", 8685),
    ("Apache-2.0", "ee683d83528d96320ae7ab37931f58defa281773fa794c574159d399491d78da", 8670),
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100", 9701),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8", 5710),
    ("Artistic-1.0-Perl", "fc5d89d0f65d2e61bca6622055b6b2dfa06ea1a4427c6cae7ae957eb2d1bef6f", 5689),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9", 1381),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32", 6664),
    ("GFDL-1.2", "e5d131a815cb62f842b018418ee94472aab61b18279a33352eac34ba070d6368", 19484),
    ("GFDL-1.2", "f06741c6c5feec30d99f80228f0d9ea6b884eae0e790ab18a0f4257184befa86", 19515),
    ("GFDL-1.3", "6426428684fd3f17f23a26d268fa4b5def4b57eb175dced0968d870a47c9cc60", 21853),
    ("GFDL-1.3", "80229e90e6f40a551a447f33ef48bd361a8e3166d53f29a2d1537245e2064feb", 21884),
    ("GPL-1.0", "004d51305feee6b52152c2f281ce28deaeb53eb4a4d007ee76cd7a921214d66a", 9360),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", 9387),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    ("GPL-1.0", "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c", 11738),
    ("GPL-1.0", "ca8a13e258985f008e9e869c46b2f9ce910ff6e64682660c0130a3a2597b9056", 9388),
    ("GPL-2.0", "5cfa3f7ab9622ce444c30e310e55205f49336ce6be3617595227c345ad8abe6b", 14392),
    ("GPL-2.0", "7175ec221f810f3c77488bcae927a355cfca53327cc1a792f6365dcb65894c8b", 14364),
    ("GPL-2.0", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017", 14391),
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", 17053),
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", 14419),
    ("GPL-2.0", "eba7bf0f746ce6a865cc3c1730fe4c267c07b5ab25d51afc43bf36c206cd5dfb", 17026),
    ("GPL-3.0", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943", 30808),
    ("GPL-3.0", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b", 30836),
    ("GPL-3.0", "845d26bfe344bd68fce9ecad2adcbae454174a305e3021b864e02a8d98f5a4e4", 30781),
    ("GPL-3.0", "c8c0ee3e23ff4b204f7b86600011be67de63a784da8f1d9ab9ecd1bdfe080766", 33250),
    ("GPL-3.0", "ec074d0161874aee7f0edfc3a76e847e32e87d55fdcaf11963c188abf460153a", 30809),
    ("GPL-3.0", "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f", 33277),
    ("LGPL-2.0", "5536e1d09b40a96e303b76bda3adb050eef5ae7eb9164e0a65d245f5bbea9f8a", 22083),
    ("LGPL-2.0", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513", 22146),
    ("LGPL-2.0", "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a", 22118),
    ("LGPL-2.0", "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135", 23999),
    ("LGPL-2.0", "f3f44bc5ab4430d11e8563d2b3daecb81b02dc0945c4c287eb79789625ad9251", 23964),
    ("LGPL-2.0", "fdb5336e6c34923f17202c5d06857ad125b404e94caa17221651c92f3e693d4a", 22111),
    ("LGPL-2.1", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70", 25086),
    ("LGPL-2.1", "38ee6d3f4593d60361059eaf615fbf407618efc85e790131c6275ea34941bb0a", 25052),
    ("LGPL-2.1", "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a", 23206),
    ("LGPL-2.1", "a22dd5edbac88e6eb7ad49cd429d9d5332c066beebd1e2c242018d8550004be1", 23172),
    ("LGPL-2.1", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1", 23234),
    ("LGPL-2.1", "e7f2b964dfec477c1c6356524bb74318bceb15cea1fb03352518f8f6653c744c", 23200),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("LGPL-3.0", "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765", 7070),
    ("MPL-1.1", "64a49d83bd8fd7a03e3441cca62f1c189748f458c0dcc541f24fe62524b4d833", 22317),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354", 22340),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", 14271),
    ("MPL-2.0", "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2", 14236),
]
